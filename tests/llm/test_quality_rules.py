import re
from collections import Counter

from tabwright.llm import quality_rules as q

from tests.llm import samples


def brute(text):
    s = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", s)
    lines = [x for x in s.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen = Counter(grams)
    covered = {p for i, g in enumerate(grams) if seen[g] > 1 for p in range(i, i + 8)}
    m = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in s), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_upper": sum("A" <= c <= "Z" for c in s)}
    failed = [m["n_words"] < 20, 100 * m["n_repeat_words"] > 30 * m["n_words"], 10 * m["n_symbols"] > m["n_words"], 10 * m["word_chars"] < 32 * m["n_words"], m["word_chars"] > 12 * m["n_words"], 100 * m["n_dup_lines"] > 40 * m["n_lines"], 2 * m["n_upper"] > m["word_chars"]]
    return m | {"fail_bits": sum(1 << k for k, x in enumerate(failed) if x), "base_failed": failed[0] or failed[1], "kept": not any(failed)}


def test_against_brute_force_and_odd_rows(spark):
    loop = "a b c d e f g h i j k l m n o p q r s t " * 3
    extra = [(20, loop), (21, "same line here\n" * 12), (22, "x y z " * 9 + "1 2 3 4 5 6 7 8 9"), (23, "# $ % word " * 20), (24, "ein zwei\nein zwei\n\n \nfünf sechs sieben " + "acht neun zehn elf zwölf " * 4)]
    docs = samples.corpus(spark, extra).unionByName(samples.odd(spark), allowMissingColumns=True)
    texts = {}
    for i, t, *_ in samples.odd_rows() + extra:
        texts.setdefault(i, []).append(brute(t))
    rows = q.assess(docs).collect()
    assert len(rows) == len(samples.odd_rows()) + len(extra)
    for r in rows:
        assert {k: r[k] for k in next(iter(texts.values()))[0]} in texts[r.doc_id], r


def test_keep_good_returns_the_columns_of_its_input(spark):
    docs = samples.odd(spark)
    kept = q.keep_good(docs)
    assert kept.columns == docs.columns
    want = sorted(str(r[:2]) for r in samples.odd_rows() if brute(r[1])["kept"])
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == want
    assert q.keep_good(samples.empty(spark)).count() == 0


def test_ablation_counts_what_each_rule_costs(spark):
    bits = [0] * 5 + [1] * 3 + [2] * 2 + [3] + [4]
    found = spark.createDataFrame([(b,) for b in bits], "fail_bits long")
    base = {r.rule: r for r in q.ablation(found, (q.BASE,)).collect()}
    assert (base["few_words"].n_docs, base["few_words"].n_kept, base["few_words"].n_kept_without, base["few_words"].n_only_this) == (12, 6, 9, 3)
    assert (base["repeated_windows"].n_kept_without, base["repeated_windows"].n_only_this) == (8, 2)
    assert q.ablation(found.limit(0)).count() == 0


def test_policies_share_one_ledger():
    assert q.CURRENT.mask == (1 << len(q.RULES)) - 1
    assert len({r.bit for r in q.RULES}) == len(q.RULES)


def test_plan_is_native(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string").filter("doc_id > 0")
    plan = q.assess(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Project" in plan and not any(x in plan for x in ("EvalPython", "InPandas", "InArrow", "Exchange"))
