"""Plain-Python counterparts for the tests."""
import re
from collections import Counter


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingle_counts(text, k=5):
    words = word_list(text)
    if not words:
        return Counter()
    if len(words) < k:
        return Counter([tuple(words)])
    return Counter(tuple(words[i:i + k]) for i in range(len(words) - k + 1))


def prob_jaccard(x, y):
    total = 0.0
    for i in x.keys() & y.keys():
        total += 1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in x.keys() | y.keys())
    return total


def classes(texts, similar):
    """Class (least index) of each text under linked pairs; equal word lists are linked."""
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [shingle_counts(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and (word_list(texts[i]) == word_list(texts[j]) or
                                        prob_jaccard(sets[i], sets[j]) >= similar):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]
