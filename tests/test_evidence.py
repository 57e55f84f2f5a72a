"""Resolution, gates, claims and comparisons on small examples."""

from pyspark.sql import functions as F

from chronofact.functions import numbers as n
from chronofact.operators import claims as c
from chronofact.operators import compare as x
from chronofact.operators import gates as g
from chronofact.operators import resolve as r
from chronofact.operators.subscriptions import normalize_email
from chronofact.plans import evidence_queries

ITEM = "item_id string, source_id string, publisher string, title string, content_text string"


def phrases(spark):
    return r.alias_table(spark.createDataFrame([("Acme", "Rocket", ["Roadrunner kit"]), ("Beta", "o1", []), ("Acme", "Glue", None)], "company string, product string, aliases array<string>"))


def test_resolution(spark):
    items = spark.createDataFrame(
        [
            ("a", "s", "Acme", "News", "the rocket flies"),
            ("b", "s", "Other", "News", "the rocket flies"),
            ("c", "s", "Other", "Acme rocket!", ""),
            ("d", "s", "Other", "Roadrunner-kit and Beta o1", None),
            ("e", "langgraph_pypi", "x", "1.0", ""),
            ("f", "s", "Other", "Roadrunner kits o1", "beta"),
            ("g", "s", "Other", None, None),
        ],
        ITEM,
    )
    got = {k["item_id"]: (k["method"], k["product"]) for k in r.resolve(items, phrases(spark)).collect()}
    assert got == {"a": ("alias_match", "Rocket"), "b": ("no_match", None), "c": ("alias_match", "Rocket"), "d": ("ambiguous_multi_subject", None), "e": ("alias_match", "LangGraph"), "f": ("alias_match", "o1"), "g": ("no_match", None)}
    assert {k["next"] for k in r.route(r.resolve(items, phrases(spark))).collect()} == {"extract", "propose", "stop"}


def test_phrase_index(spark):
    """Phrases are filed under their rarest word; both ways of finding them agree with the plain search."""
    import random

    rng = random.Random(2)
    words = ["the", "of", "longcommonword", *[f"w{i}" for i in range(60)]]
    weights = [200, 150, 150, *[3] * 60]
    texts = [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 60)))) for i in range(400)]
    made = sorted({" ".join(rng.choices(words, weights, k=rng.randint(1, 3))) for _ in range(80)})
    t = spark.createDataFrame(texts, "item_id long, haystack string")
    p = spark.createDataFrame([("C", f"P{i}", x, True) for i, x in enumerate(made)], "company string, product string, phrase string, strong boolean")
    want = sorted((i, x) for i, text in texts for x in made if f" {x} " in f" {text} ")
    for most in (5000, 3):
        assert sorted((k["item_id"], k["phrase"]) for k in r.phrase_join(t, p, most=most).collect()) == want
    filed = r.filed_phrases(t, p, sample=1.0)
    longest = p.withColumn("_word", F.array_max(F.transform(F.split("phrase", " "), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    rare, long = (r.phrase_candidates(t, f).count() for f in (filed, longest))
    assert len(want) <= rare < 0.8 * long
    assert all("longcommonword" != k["_word"] or set(k["phrase"].split()) <= {"the", "of", "longcommonword"} for k in filed.collect())


def test_proposals(spark):
    items = spark.createDataFrame([(str(i), "Rocket seen", "x" * 490 + " Rocket late") for i in range(7)], "item_id string, title string, content_text string").withColumn("candidates", F.array(F.struct(F.lit("Acme").alias("company"), F.lit("Rocket").alias("product"))))
    p = spark.createDataFrame([("0", "Acme", "Rocket", None, "Rocket seen", 0.9), ("1", "Acme", "Rocket", None, "Rocket late", 0.9), ("2", "Acme", "Boat", None, "Rocket seen", 0.9), ("3", None, None, "Boat", None, 0.7), ("4", "Acme", "Rocket", None, "Rocket seen", 0.5), ("5", "Acme", "Rocket", None, "Rocket seen", float("nan")), ("6", "Acme", "Rocket", None, "Rock", 0.9)], "item_id string, company string, product string, new_subject_proposal string, supporting_quote string, confidence double")
    got = {k["item_id"]: k["method"] for k in r.judge_proposals(items, p, phrases(spark)).collect()}
    assert got == {"0": "llm_resolved", "1": "llm_unsupported_subject_evidence", "2": "llm_subject_not_in_candidates", "3": "llm_new_subject_proposal", "4": "llm_low_confidence", "5": "llm_low_confidence", "6": "llm_unsupported_subject_evidence"}


def test_gates(spark):
    text = "Input costs 5 and output costs 15. Context window is 100K tokens. Licence terms have not been announced. Output pricing has not been announced, but the model supports text."
    cases = [
        ("context_window", "100K", "disclosed", "Context window is 100K tokens", 0.9, None),
        ("context_window", "100000", "disclosed", "Context window is 100K tokens", 0.9, "duplicate"),
        ("input_price_usd", "5", "disclosed", "Input costs 5 and output costs 15", 0.9, "ambiguous_attribution"),
        ("output_price_usd", "15", "disclosed", "output costs 15", 0.9, None),
        ("colour", "red", "disclosed", "Context window", 0.9, "unknown_field"),
        ("licence_terms", None, "not_disclosed", "Licence terms have not been announced", 0.9, None),
        ("modalities", "text", "disclosed", "the model supports text", 0.3, "low_confidence"),
        ("benchmark_scores", None, "disclosed", "x", 0.9, "bad_shape"),
        ("availability_regions", "Mars", "disclosed", "available on Mars", 0.9, "ungrounded_span"),
    ]
    rows = [("s", f, v, st, q, cf, i) for i, (f, v, st, q, cf, _) in enumerate(cases)]
    kind = "snapshot_id string, field string, value string, disclosure_status string, quoted_span string, confidence double, cand_pos int"
    got = {k["cand_pos"]: k["reason"] for k in g.gate_facts(spark.createDataFrame(rows, kind), spark.createDataFrame([("s", text)], "snapshot_id string, content_text string")).collect()}
    assert got == {i: k[5] for i, k in enumerate(cases)}
    rows = [("s", "modalities", "text", "disclosed", "the model supports text", 0.9, 0), ("s", "modalities", "audio", "disclosed", "the model supports text", 0.9, 1), ("s", "input_price_usd", None, "not_disclosed", "Output pricing has not been announced", 0.9, 2), ("t", "modalities", "text", "disclosed", "", 0.9, 3), ("s", "benchmark_scores", "Zed", "disclosed", "the model", 0.9, 4)]
    got = [k["reason"] for k in g.gate_facts(spark.createDataFrame(rows, kind), spark.createDataFrame([("s", text)], "snapshot_id string, content_text string")).orderBy("cand_pos").collect()]
    assert got == ["conflicting_candidates", "conflicting_candidates", "non_disclosure_not_supported", "ungrounded_span", "value_not_in_quote"]


def test_claims(spark):
    snaps = spark.createDataFrame([("s1", "costs $1,000 now"), ("s2", None)], "snapshot_id string, content_text string")
    rows = spark.createDataFrame([("a", "d", "It is 1000.", ["s1"]), ("b", "d", "It is 2000.", ["s1", "s2"]), ("c", "e", "No numbers.", ["nope"]), ("d", "e", "No numbers.", []), ("e", "f", "No numbers.", ["s2"])], "claim_id string, digest_date string, text string, citations array<string>")
    done = c.validate_claims(rows, snaps)
    assert {k["claim_id"]: k["validation_status"] for k in done.collect()} == {"a": "supported", "b": "unsupported", "c": "unsupported", "d": "unsupported", "e": "supported"}
    dates = spark.createDataFrame([("d",), ("e",), ("f",), ("g",)], "digest_date string")
    digests = c.assemble_digests(dates, done)
    assert {k["digest_date"]: k["status"] for k in digests.collect()} == {"d": "review", "e": "review", "f": "published", "g": "draft"}
    assert {k["digest_date"]: k["status"] for k in c.veto(digests, dates.where("digest_date = 'f'"), dates.where("digest_date = 'g'")).collect()} == {"d": "review", "e": "review", "f": "review", "g": "review"}


def test_comparisons(spark):
    grid = x.fact_table(
        spark.createDataFrame([("A", "P", "a", "p"), ("B", "P", "b", "p"), ("C", "P", "c", "p")], "company string, product string, company_key string, product_key string"),
        ["context_window_tokens", "input_price_usd"],
        spark.createDataFrame([("a", "p", "context_window_tokens", "100", "disclosed", "1"), ("b", "p", "context_window_tokens", "20", "disclosed", "2"), ("a", "p", "input_price_usd", "$5", "disclosed", "1"), ("b", "p", "input_price_usd", "$7", "disclosed", "2")], "company_key string, product_key string, field string, value string, disclosure_status string, snapshot_id string"),
    )
    pairs = spark.createDataFrame([("a", "p", "b", "p", "context_window_tokens", 0), ("b", "p", "a", "p", "context_window_tokens", 1), ("a", "p", "c", "p", "context_window_tokens", 2), ("a", "p", "a", "p", "x", 3), ("a", "p", "z", "p", "x", 4), ("a", "p", "b", "p", "input_price_usd", 5)], "company_key_a string, product_key_a string, company_key_b string, product_key_b string, field string, pair_pos int")
    got = {k["pair_pos"]: (k["reason"], k["relation"]) for k in x.compare_pairs(pairs, grid).collect()}
    assert got == {0: (None, "higher"), 1: (None, "lower"), 2: ("value_unknown", None), 3: ("subject_compared_to_itself", None), 4: ("unknown_subject", None), 5: ("field_not_comparable", None)}
    assert x.compare_pairs(pairs, grid, x.RULES | x.PRICE_RULES).where("pair_pos = 5").first()["text"] == "A's P has a lower input price (USD) ($5) than B's P ($7)."
    assert x.dedupe_reversed_pairs(pairs).count() == 5 and x.all_pairs(grid).count() == 2


def test_emails(spark):
    df = spark.createDataFrame([(v,) for v in (" Bob@Bücher.example ", "a@b", "a@b.c@d.e", ".a@b.cd", "a..b@b.cd", "a@-b.cd", None, "ok@x.org", "e\u0301@x.org", "a@x_y.org", "a b@x.org", "a@" + "l" * 64 + ".org", "\u00a0c@X.ORG\x1f", "é" * 316 + "@x.org", "a@b.c.", "a.@x.org", "x@ß.org")], "v string")
    assert [k[0] for k in df.select(normalize_email("v")).collect()] == ["Bob@xn--bcher-kva.example", None, None, None, None, None, None, "ok@x.org", "\u00e9@x.org", None, None, None, "c@x.org", None, None, None, "x@ss.org"]


def test_candidates_are_judged_once(spark):
    """Numbers and clauses of a candidate are told once and stored; no join or filter tells them again."""
    cands = spark.createDataFrame([(1, 1, "input_price_usd", "5", "disclosed", "costs 5, K or 2.5%M", 0.9), (1, 2, "output_price_usd", None, "not_disclosed", "Output pricing has not been announced", 0.9)], "snapshot_id long, cand_pos long, field string, value string, disclosure_status string, quoted_span string, confidence double")
    snaps = spark.createDataFrame([(1, "It costs 5, K or 2.5%M. Output pricing has not been announced.")], "snapshot_id long, content_text string")
    got = g.gate_facts(cands, snaps)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "withheld|" not in plan
    assert {r["cand_pos"]: r["reason"] for r in got.collect()} == {1: None, 2: None}
    assert [tuple(r) for r in cands.select(n.numbers_in(F.col("quoted_span")), n.all_numbers(F.col("quoted_span"))).orderBy("cand_pos").collect()] == [([], ["2500000", "5000"]), ([], [])]


def test_gates_read_texts_once_more(spark, sf_dir):
    """Once for the candidates, which are stored, and once for the snapshots."""
    plan = evidence_queries.g12_gates(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(regexp_replace(coalesce(text") == 1


def test_gates_shuffle_whole_candidates_once(spark):
    """One shuffle for candidates, one for their spans and numbers, one for texts; values of several numbers contaminate quotes that have them all."""
    cases = [
        ("s", 1, "benchmark_scores", "5 and 7", "scores 5 and 7", None),
        ("s", 2, "input_price_usd", "3", "3 beside 5 and 7", "ambiguous_attribution"),
        ("s", 3, "output_price_usd", "9", "7 or 9", None),
        ("t", 4, "input_price_usd", "5", "costs 5 or 6", None),
        ("t", 5, "input_price_usd", "5", "costs 5", "duplicate"),
        ("u", 7, "input_price_usd", "5", "costs 5", "ungrounded_span"),
        ("v", 8, None, "5", "costs 5", None),
        ("v", 9, None, "5", "costs 5", "duplicate"),
        ("v", 10, None, "6", "costs 6", None),
    ]
    cands = spark.createDataFrame([(s, i, f, v, "disclosed", q, 0.9) for s, i, f, v, q, _ in cases], "snapshot_id string, cand_pos long, field string, value string, disclosure_status string, quoted_span string, confidence double")
    snaps = spark.createDataFrame([("s", "scores 5 and 7, 3 beside 5 and 7, 7 or 9"), ("t", "costs 5 or 6"), ("v", "costs 5, costs 6")], "snapshot_id string, content_text string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = g.gate_facts(cands, snaps)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 3, plan
        assert {r["cand_pos"]: r["reason"] for r in got.collect()} == {i: why for _, i, _, _, _, why in cases}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
