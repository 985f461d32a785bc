import re

import duckdb

from sparkpanel.llm import rule_ledger

from .brute import word_list


def brute(text):
    text = text or ""
    words = word_list(text)
    lines = [x for x in text.split("\n") if word_list(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": dup, "n_repeat_words": len(covered), "n_lines": len(lines),
            "n_upper": len(re.findall("[A-Z]", text)), "n_lower": len(re.findall("[a-z]", text)), "n_exclaim": text.count("!")}


def test_ledger_matches_brute_force(hard, none):
    texts = {(r.doc_id, r.text) for r in hard.select("doc_id", "text").collect()}
    got = rule_ledger.apply_policy(rule_ledger.ledger(hard)).collect()
    assert len(got) == hard.count()
    want = {str((k, sorted(brute(t).items()))) for k, t in texts}
    assert {str((r.doc_id, sorted((m, r[m]) for m in rule_ledger.MEASURES))) for r in got} == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert rule_ledger.ledger(none).collect() == []


def test_sql_says_the_same(hard):
    documents = hard.select("doc_id", "text").toPandas()  # noqa: F841 - read by DuckDB
    want = duckdb.sql(rule_ledger.SQL).df()
    got = rule_ledger.apply_policy(rule_ledger.ledger(hard)).toPandas()[list(want.columns)]
    key = [c for c in want.columns if c not in ("policy",)]
    assert sorted(map(str, got[key].astype(object).values.tolist())) == \
        sorted(map(str, want[key].astype(object).values.tolist()))


def test_policies_and_ablations(hard):
    led = rule_ledger.ledger(hard)
    bits = [r.fail_bits for r in led.collect()]
    names = list(rule_ledger.RULES)
    for r in rule_ledger.ablations(led).collect():
        mask = rule_ledger.mask(rule_ledger.POLICIES[r.policy])
        own = 1 << names.index(r.rule)
        assert r.n_failed == sum(b & own > 0 for b in bits)
        assert r.n_only == sum(b & mask == own for b in bits)
        assert r.n_rejected == sum(b & mask > 0 for b in bits)
    for policy, rules in rule_ledger.POLICIES.items():
        kept = rule_ledger.apply_policy(led, policy).filter("kept").count()
        assert kept == sum(not b & rule_ledger.mask(rules) for b in bits)
