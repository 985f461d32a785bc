"""Quality rules as a ledger of failure bits (operator 4).

One pass over the texts evaluates every rule once and stores, per document,
the measurements and a bitmask of the rules that it fails.  Policies are named,
versioned masks over the same bits: applying one, or asking what a rule alone
costs, is bitwise arithmetic on the ledger and reads no text again.

Null texts count as empty.  An empty or blank text fails ``few_words`` (and nothing
else), an empty table gives an empty ledger, repeated rows get equal rows; there is nothing to tie.
A very long text is a slice of its own.  Null doc_ids are kept.  Only doc_id and text are
read, so extra columns can't clash.
Windows and lines are compared by 64-bit hashes within one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .arrays import Slice, mix, per_text, slices, window_hash

SYMBOLS = b"#*$%&|<>"
WINDOW = 8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_upper", "n_lower", "n_exclaim")

#: Bit i of ``fail_bits`` is rule i: true where the document fails it.
RULES = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "shouting": "n_upper > n_lower",
    "exclamation": "5 * n_exclaim > n_words",
    "word_length": "word_chars > 20 * n_words",
}

BASE = ("few_words", "repeated_windows")
#: Versioned policies: the rules that reject a document.
POLICIES = {
    "base.v1": BASE,
    "prose.v1": (*BASE, "symbols", "duplicate_lines", "shouting"),
    "prose.v2": (*BASE, "symbols", "duplicate_lines", "shouting", "exclamation", "word_length"),
}
DEFAULT_POLICY = "prose.v2"

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def measure(s: Slice) -> dict[str, np.ndarray]:
    """The measurements of each text of a slice."""
    owner = np.repeat(np.arange(s.n), np.diff(s.offsets))

    def bytes_where(mask: np.ndarray) -> np.ndarray:
        return per_text(owner[mask], s.n)

    data = s.data
    out = {"n_words": s.n_words.astype(np.int64), "n_symbols": bytes_where(_IS_SYMBOL[data]),
           "n_upper": bytes_where((data >= 65) & (data <= 90)), "n_lower": bytes_where((data >= 97) & (data <= 122)),
           "n_exclaim": bytes_where(data == 33)}
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points begin at other than 10xxxxxx
    out["word_chars"] = per_text(s.doc_of_word, s.n, heads[s.ends] - heads[s.starts]).astype(np.int64)

    # lines: cut at \n and at the texts' ends; only lines with a word count
    newlines = np.flatnonzero(data == 10)
    line_ends = np.sort(np.concatenate([newlines, s.offsets[1:]]))
    line_starts = np.sort(np.concatenate([newlines + 1, s.offsets[:-1]]))
    has_word = np.searchsorted(s.starts, line_ends) > np.searchsorted(s.starts, line_starts)
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    doc = np.searchsorted(s.offsets, line_starts, side="right") - 1
    out["n_lines"] = per_text(doc, s.n)
    lines = mix(s.span_hash(line_starts, line_ends) ^ mix(doc.astype(np.uint64), 1))
    distinct = np.unique(lines, return_index=True)[1]
    out["n_dup_lines"] = out["n_lines"] - per_text(doc[distinct], s.n)

    at, doc = s.windows(WINDOW)
    keys = mix(window_hash(s.word_hash(), at, WINDOW) ^ mix(doc.astype(np.uint64), 2))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(s.starts) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    out["n_repeat_words"] = per_text(s.doc_of_word[np.cumsum(cover[:-1]) > 0], s.n)
    return out


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, fail_bits (one bit for each rule of RULES)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column("text")):
                got = measure(s)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(s.first, s.n), *[pa.array(got[m], pa.int64()) for m in MEASURES]],
                    names=["doc_id", *MEASURES])

    measured = shared.doc_text(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())),
               F.lit(0))
    return measured.withColumn("fail_bits", bits.cast("long"))


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def apply_policy(led: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """The ledger with base_failed, kept (no rule of the policy fails), the policy's name and ``only_rule``: the
    one rule whose removal from the policy would keep the document (null if it is kept, or fails several)."""
    bits = F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy]) | mask(BASE)))
    out = (led.withColumn("base_failed", F.col("fail_bits").bitwiseAND(F.lit(mask(BASE))) != 0)
           .withColumn("kept", bits == 0).withColumn("policy", F.lit(policy)))
    names = F.array(*[F.lit(r) for r in RULES])
    single = F.bit_count(bits) == 1
    return out.withColumn("only_rule", F.when(single, F.element_at(names, (F.round(F.log2(bits.cast("double"))) + 1).cast("int"))))


def ablations(led: DataFrame) -> DataFrame:
    """policy, rule, n_failed (documents failing the rule), n_only (rejected by it alone: what
    leaving it out would give back), n_rejected (by the whole policy).

    The ledger is first counted by its bit patterns, so what follows has at
    most 2 to the number of rules rows.
    """
    patterns = led.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    rows = [(p, r, mask(rules), 1 << list(RULES).index(r)) for p, rules in POLICIES.items() for r in rules]
    which = F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(m).alias("mask"),
                                         F.lit(b).alias("bit")) for p, r, m, b in rows])).alias("w")
    hit = F.col("fail_bits").bitwiseAND(F.col("mask"))
    return (patterns.select("fail_bits", "n", which).select("fail_bits", "n", "w.*")
            .groupBy("policy", "rule")
            .agg(F.sum(F.when(F.col("fail_bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
                 F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
                 F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("n_rejected")))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS g
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(len(ls) AS BIGINT) AS n_lines,
             CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper,
             CAST(length(regexp_replace(t, '[^a-z]', '', 'g')) AS BIGINT) AS n_lower,
             CAST(length(regexp_replace(t, '[^!]', '', 'g')) AS BIGINT) AS n_exclaim
      FROM w LEFT JOIN rep USING (rid)),
b AS (SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT
                     + 4 * (10 * n_symbols > n_words)::INT + 8 * (2 * n_dup_lines > n_lines)::INT
                     + 16 * (n_upper > n_lower)::INT + 32 * (5 * n_exclaim > n_words)::INT
                     + 64 * (word_chars > 20 * n_words)::INT AS BIGINT) AS fail_bits FROM m)
SELECT *, (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 127) = 0 AS kept, 'prose.v2' AS policy,
       CASE fail_bits & 127 WHEN 1 THEN 'few_words' WHEN 2 THEN 'repeated_windows' WHEN 4 THEN 'symbols' WHEN 8 THEN 'duplicate_lines'
                            WHEN 16 THEN 'shouting' WHEN 32 THEN 'exclamation' WHEN 64 THEN 'word_length' END AS only_rule FROM b
"""
