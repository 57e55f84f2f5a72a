"""Queries of resolution, evidence gates, claims, digests and comparisons, over documents, conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofact.functions import numbers as n
from chronofact.operators import claims as c
from chronofact.operators import compare as x
from chronofact.operators import evaluate as e
from chronofact.operators import gates as g
from chronofact.operators import history as h
from chronofact.operators import resolve as r
from chronofact.plans.facts_queries import CHANGES
from chronofact.plans.tables import OBSERVATIONS, observations, read


def _subjects(spark, sf_dir):
    """benchmark passages as subjects: a publisher as company, the first word as product, the first eight as an alias."""
    words = F.split(F.trim("text"), r"\s+")
    return read(spark, sf_dir, "benchmark").select(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("company"), F.concat_ws(" ", words[0], F.col("item_id").cast("string"), words[1]).alias("product"), F.array(F.concat_ws(" ", F.slice(words, 1, 8)), words[2]).alias("aliases"))


def _items(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.when(F.col("doc_id") % 101 == 0, F.lit("langgraph_pypi")).otherwise(F.col("source")).alias("source_id"), F.col("source").alias("publisher"), F.substring(F.coalesce("text", F.lit("")), 1, 30).alias("title"), F.col("text").alias("content_text"))


def r1_phrases(spark, sf_dir):
    return r.alias_table(_subjects(spark, sf_dir)).select("company", "product", "phrase", "strong")


def r2_trusted_sources(spark, sf_dir):
    return r.trusted_source_match(_items(spark, sf_dir)).select("item_id", "company", "product", "matched_text")


def r3_phrase_matches(spark, sf_dir):
    return r.phrase_join(r.with_haystack(_items(spark, sf_dir)), r.alias_table(_subjects(spark, sf_dir))).select("item_id", "company", "product", "phrase")


def r4_gated_matches(spark, sf_dir):
    """Bare names as phrases: the second word of a passage, held to the publisher."""
    words = F.split(F.trim("text"), r"\s+")
    bare = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("company"), words[1].alias("product"), r.normalise_name(words[1]).alias("phrase"), F.lit(False).alias("strong")).where("length(phrase) >= 2").distinct()
    hay = r.with_haystack(_items(spark, sf_dir))
    return r.gated_matches(hay, bare).select("item_id", "company", "product")


def r5_resolutions(spark, sf_dir):
    return r.resolve(_items(spark, sf_dir), r.alias_table(_subjects(spark, sf_dir))).select("item_id", "method", "company", "product", "matched_text", F.coalesce(F.size("candidates"), F.lit(0)).alias("n_candidates"))


def r6_quotes(spark, sf_dir):
    """Passages as quotes for their subjects, in the documents that follow them in number."""
    words = F.split(F.trim("text"), r"\s+")
    quotes = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"), F.concat_ws(" ", F.slice(words, 1, 3)).alias("product"), F.lit("Bench").alias("company"))
    docs = read(spark, sf_dir, "documents").select((F.col("doc_id") % 40).alias("item_id"), "doc_id", "text")
    rows = docs.join(quotes, "item_id")
    phrases = quotes.select("company", "product", r.normalise_name(F.col("product")).alias("phrase")).distinct()
    return r.quote_supports_subject(rows, phrases, "doc_id", "quote", "text")


def r7_proposals(spark, sf_dir):
    """Proposals for every item: a candidate, another subject or none, quoting the first words, with varying confidence."""
    items = _items(spark, sf_dir).withColumn("candidates", F.array(F.struct(F.lit("Acme").alias("company"), F.split(F.col("title"), " ")[0].alias("product"))))
    p = _items(spark, sf_dir).select("item_id", F.when(F.col("item_id") % 5 != 0, F.lit("Acme")).alias("company"), F.when(F.col("item_id") % 3 == 0, F.lit("Other")).otherwise(F.split(F.col("title"), " ")[0]).alias("product"), F.lit("New").alias("new_subject_proposal"), F.when(F.col("item_id") % 7 != 0, F.split(F.col("title"), " ")[0]).otherwise(F.lit("invented")).alias("supporting_quote"), ((F.col("item_id") % 10) / 10.0).alias("confidence"))
    phrases = items.select(F.col("candidates")[0]["company"].alias("company"), F.col("candidates")[0]["product"].alias("product")).distinct().withColumn("phrase", r.normalise_name(F.col("product"))).where("length(phrase) >= 2")
    return r.judge_proposals(items, p, phrases).groupBy("method").agg(F.count("*").alias("n"), F.sum("item_id").alias("ids"))


def r8_registry(spark, sf_dir):
    names = read(spark, sf_dir, "events").select(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Company "), F.col("user_id").cast("string"))).otherwise(F.concat(F.lit("company-"), F.col("user_id").cast("string"), F.lit("."))).alias("company"), F.initcap("event_type").alias("product"), F.col("ts").alias("created_at"))
    return r.subject_registry(names)


def r9_routes(spark, sf_dir):
    return r.route(r.resolve(_items(spark, sf_dir), r.alias_table(_subjects(spark, sf_dir)))).groupBy("next").agg(F.count("*").alias("n"))


def p14_numbers(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(n.numbers_in(F.col("text")), ",").alias("numbers"))


def p15_multipliers(spark, sf_dir):
    """Multiplied numbers of the values of events, written with units."""
    text = F.concat(F.lit("about "), F.floor("value").cast("string"), F.when(F.col("event_id") % 2 == 0, F.lit("K")).otherwise(F.lit(" m")), F.lit(" tokens"))
    return read(spark, sf_dir, "events").select("event_id", F.array_join(n.multiplier_numbers(text), ",").alias("numbers"))


_FIELDS = ["context_window", "input_price_usd", "output_price_usd", "licence_terms", "modalities", "benchmark_scores", "colour"]


def _candidates(spark, sf_dir):
    """Three candidates a snapshot: from words of documents without digits, some from the wrong text, some withheld."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[0-9]", ""), r"[^A-Za-z]+", " ")).alias("t"))
    texts, docs = docs, docs.select("doc_id", F.split("t", " ", 7).alias("w"))
    k = F.col("doc_id")
    hidden = k % 4 == 0
    quote = F.when(hidden, F.when(k % 8 == 0, F.lit("Input pricing has not been announced")).otherwise(F.lit("Licence terms are not yet public"))).otherwise(F.concat_ws(" ", F.slice("w", 1, 6)))
    value = F.when(~hidden, F.when(k % 5 == 0, F.lit("Zzz Zzz")).otherwise(F.concat_ws(" ", F.slice("w", 2, 2))))
    field = F.element_at(F.array(*[F.lit(f) for f in _FIELDS]), (k % 7 + 1).cast("int"))
    cands = docs.select(F.floor(k / 3).alias("snapshot_id"), k.alias("cand_pos"), field.alias("field"), value.alias("value"), F.when(hidden, F.lit("not_disclosed")).otherwise(F.lit("disclosed")).alias("disclosure_status"), quote.alias("quoted_span"), ((k % 10 + 1) / 10.0).alias("confidence"))
    # A snapshot has the texts of three documents; every third one is filed with the next ones, so its own quotes aren't grounded.
    said = F.concat("t", F.when(k % 3 == 0, F.lit(". Input pricing has not been announced. Licence terms are not yet public.")).otherwise(F.lit("")))
    parts = texts.select(F.floor((k + 1) / 3).alias("snapshot_id"), F.struct(k.alias("k"), said.alias("said")).alias("part"))
    both = parts.groupBy("snapshot_id").agg(F.array_join(F.array_sort(F.collect_list("part"))["said"], " ").alias("content_text"))
    return cands, both


def g12_gates(spark, sf_dir):
    cands, snaps = _candidates(spark, sf_dir)
    return g.gate_facts(cands, snaps).select("snapshot_id", "cand_pos", "field", "accepted", "reason")


def g12_gate_counts(spark, sf_dir):
    cands, snaps = _candidates(spark, sf_dir)
    return g.gate_counts(g.gate_facts(cands, snaps))


def d1_claims(spark, sf_dir):
    out = c.draft_claims(h.detect_changes(observations(spark, sf_dir)))
    return out.select("company_key", "field", "text", F.concat_ws(",", F.transform("citations", lambda i: i.cast("string"))).alias("citations"))


def _turns(spark, sf_dir):
    """Assistant turns as claims of their conversation's digest, citing the turns before them; 'the' stays out of it."""
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["conv_id", "turn"])
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    before = F.when(F.col("turn") > 0, F.transform(F.sequence(F.greatest(F.col("turn") - 2, F.lit(0)), F.col("turn") - 1), lambda i: F.concat_ws("-", F.col("conv_id").cast("string"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    claims = t.where("role = 'assistant'").select(key.alias("claim_id"), F.col("conv_id").alias("digest_date"), F.col("conv_id").alias("digest_id"), F.col("turn").alias("position"), "text", before.alias("citations"))
    return t, claims, t.where("turn % 5 <> 3").select(key.alias("snapshot_id"), F.col("text").alias("content_text"), "conv_id")


def d2_citations_exist(spark, sf_dir):
    _, claims, snaps = _turns(spark, sf_dir)
    return c.validate_claims(claims, snaps, check_numbers=False).select("claim_id", "citations_exist", "validation_status")


def d4_validation(spark, sf_dir):
    _, claims, snaps = _turns(spark, sf_dir)
    return c.validate_claims(claims, snaps).select("claim_id", "citations_exist", "numbers_grounded", "validation_status")


def d5_digests(spark, sf_dir):
    t, claims, snaps = _turns(spark, sf_dir)
    checked = c.validate_claims(claims, snaps, check_numbers=False)
    return c.assemble_digests(t.select(F.col("conv_id").alias("digest_date")), checked)


def d6_vetoes(spark, sf_dir):
    t, claims, snaps = _turns(spark, sf_dir)
    digests = c.assemble_digests(t.select(F.col("conv_id").alias("digest_date")), c.validate_claims(claims, snaps, check_numbers=False))
    return c.veto(digests, t.where("conv_id % 3 = 0").select(F.col("conv_id").alias("digest_date")), t.where("conv_id % 7 = 0").select(F.col("conv_id").alias("digest_date"))).select("digest_date", "status")


def d7_reconciled(spark, sf_dir):
    """Every conversation's claims against a published digest of its date with the same claims, or one fewer."""
    t, claims, _ = _turns(spark, sf_dir)
    new = claims.select("digest_id", "digest_date").distinct().select("digest_id", "digest_date", F.lit("draft").alias("status"), (F.col("digest_id") % 11 == 0).alias("failed"))
    old = new.where("digest_id % 2 = 0").select((F.col("digest_id") + 1000000).alias("digest_id"), "digest_date")
    old_claims = claims.where("digest_id % 4 = 0 or position > 1").withColumn("digest_id", F.col("digest_id") + 1000000)
    return c.reconcile_published(new, claims, old, old_claims).select("digest_id", "status", "outcome", "final_digest_id")


def _hydrated(spark, sf_dir):
    t, claims, snaps = _turns(spark, sf_dir)
    checked = c.validate_claims(claims, snaps, check_numbers=False).withColumn("change_id", F.lit(None).cast("string"))
    cites = claims.select("claim_id", F.posexplode("citations").alias("position", "snapshot_id"))
    items = t.select(F.col("conv_id").alias("item_id"), F.concat(F.lit("https://example.org/"), F.col("conv_id").cast("string")).alias("canonical_url"), F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("title")).distinct()
    digests = c.assemble_digests(t.select(F.col("conv_id").alias("digest_date")), checked).withColumn("digest_id", F.col("digest_date"))
    return c.hydrate_digests(digests, checked, cites, snaps.withColumnRenamed("conv_id", "item_id"), items)


def d8_hydrated(spark, sf_dir):
    lines = F.transform("claims", lambda k: F.concat(k["claim_id"], F.lit(">"), F.array_join(F.transform(k["citations"], lambda i: F.concat(i["snapshot_id"], F.lit("@"), F.coalesce(i["url"], F.lit("?")))), "+")))
    return _hydrated(spark, sf_dir).select("digest_id", "status", F.array_join(lines, " ").alias("claims"))


def d9_details(spark, sf_dir):
    return c.digest_detail(_hydrated(spark, sf_dir)).select("digest_id", "intact", F.size("claims").alias("n_claims"))


def d10_write_rules(spark, sf_dir):
    """Orders as stored digests, and a new version of each second one."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("digest_id"), F.to_date("o_orderdate").alias("digest_date"), F.when(F.col("o_orderstatus") == "F", F.lit("published")).otherwise(F.lit("draft")).alias("status"), F.col("o_orderpriority").alias("signature"))
    new = o.withColumn("digest_id", F.when(F.col("digest_id") % 13 == 0, -F.col("digest_id")).otherwise(F.col("digest_id"))).withColumn("signature", F.when(F.col("digest_id") % 2 == 0, F.lit("new")).otherwise(F.col("signature"))).withColumn("digest_date", F.when(F.col("digest_id") % 5 == 0, F.date_add("digest_date", 1)).otherwise(F.col("digest_date")))
    return c.digest_write_rules(o, new)


def d11_published(spark, sf_dir):
    t, claims, snaps = _turns(spark, sf_dir)
    digests = t.select(F.col("conv_id").alias("digest_date")).distinct().withColumn("status", F.when(F.col("digest_date") % 9 == 0, F.lit("published")).otherwise(F.lit("draft")))
    return c.publish(digests, claims, snaps)[1].select("digest_date", "status")


def _grid(spark, sf_dir):
    """Whole values as context sizes, some odd."""
    facts = observations(spark, sf_dir).withColumn("value", F.when(F.col("id") % 19 == 0, F.concat("value", F.lit("?"))).otherwise(F.floor(F.col("value").cast("double")).cast("string")))
    current = h.current_facts(facts).withColumn("field", F.when(F.col("field") == "click", F.lit("context_window_tokens")).otherwise(F.col("field")))
    return x.fact_table(current, ["context_window_tokens", "error", "shutdown"], current)


def x1_fact_table(spark, sf_dir):
    return _grid(spark, sf_dir).select("company_key", "field", "value", "disclosure_status", "snapshot_id")


def _pairs(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    key = lambda col, m: F.concat(F.lit("company "), (F.col(col) % m).cast("string"))
    return o.select(key("o_orderkey", 160).alias("company_key_a"), F.lit("usage").alias("product_key_a"), key("o_custkey", 160).alias("company_key_b"), F.lit("usage").alias("product_key_b"), F.when(F.col("o_orderstatus") == "O", F.lit("context_window_tokens")).when(F.col("o_orderstatus") == "F", F.lit("error")).otherwise(F.lit("shutdown")).alias("field"), F.col("o_orderkey").alias("pair_pos"))


def x2_comparisons(spark, sf_dir):
    return x.compare_pairs(_pairs(spark, sf_dir), _grid(spark, sf_dir)).select("pair_pos", "reason", "relation", "text")


def x3_pairs(spark, sf_dir):
    return x.dedupe_reversed_pairs(_pairs(spark, sf_dir)).select("pair_pos", "field")


def x4_all_pairs(spark, sf_dir):
    """Pairs of subjects by the field that both disclose, in lists, which the count leaves unwritten."""
    return x.pair_lists(_grid(spark, sf_dir)).groupBy("field", "company_key_a").agg(F.sum(F.size("others")).alias("n"))


def x4_pair_counts(spark, sf_dir):
    """The same numbers from ranks."""
    return x.pair_counts(_grid(spark, sf_dir)).groupBy("field", F.col("company_key").alias("company_key_a")).agg(F.sum("n").alias("n"))


def x5_price_comparisons(spark, sf_dir):
    """The same pairs with prices as the field and their rule registered."""
    grid = _grid(spark, sf_dir).withColumn("field", F.when(F.col("field") == "context_window_tokens", F.lit("input_price_usd")).otherwise(F.col("field")))
    pairs = _pairs(spark, sf_dir).withColumn("field", F.when(F.col("field") == "context_window_tokens", F.lit("input_price_usd")).otherwise(F.col("field")))
    return x.compare_pairs(pairs, grid, x.RULES | x.PRICE_RULES).groupBy(F.coalesce("reason", "relation").alias("outcome")).agg(F.count("*").alias("n"))


def _checked(spark, sf_dir):
    _, claims, snaps = _turns(spark, sf_dir)
    return c.validate_claims(claims, snaps, check_numbers=False)


def e1_evaluation(spark, sf_dir):
    return e.evaluate(_checked(spark, sf_dir)).select("digest_id", "pooled", "n_claims", "n_unsupported", F.round("citation_validity", 9).alias("citation_validity"), "n_repeats", F.round("duplicate_rate", 9).alias("duplicate_rate"))


def e4_recall(spark, sf_dir):
    found = h.detect_changes(observations(spark, sf_dir).where("observed_at < timestamp_ntz '2024-01-02'"))
    return e.change_recall(found, h.detect_changes(observations(spark, sf_dir))).select("n_expected", "n_found", F.round("recall", 9).alias("recall"))


def e6_replay(spark, sf_dir):
    return e.replay_case(observations(spark, sf_dir).withColumn("in_detected", F.coalesce(F.col("value").cast("double") > 60, F.lit(False)))).select("n_expected", "n_found", F.round("recall", 9).alias("recall"))


QUERIES = {q.__name__: q for q in (r1_phrases, r2_trusted_sources, r3_phrase_matches, r4_gated_matches, r5_resolutions, r6_quotes, r7_proposals, r8_registry, r9_routes, p14_numbers, p15_multipliers, g12_gates, g12_gate_counts, d1_claims, d2_citations_exist, d4_validation, d5_digests, d6_vetoes, d7_reconciled, d8_hydrated, d9_details, d10_write_rules, d11_published, x1_fact_table, x2_comparisons, x3_pairs, x4_all_pairs, x4_pair_counts, x5_price_comparisons, e1_evaluation, e4_recall, e6_replay)}

_NAME = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


def _name(expr: str) -> str:
    return _NAME.format(expr)


PHRASES = f"""
    subj as (select 'src' || (item_id % 20) as company, concat_ws(' ', w[1], item_id::varchar, w[2]) as product, [array_to_string(w[1:8], ' '), w[3]] as aliases from (select item_id, regexp_split_to_array(trim(text), '\\s+') as w from benchmark)),
    phr0 as (select company, product, {_name("company || ' ' || product")} as phrase, true as strong from subj union all select company, product, {_name("a")}, true from (select company, product, unnest(aliases) as a from subj) union all select company, product, {_name("product")}, false from subj),
    phr as (select company, product, phrase, bool_or(strong) as strong from phr0 where length(phrase) >= 2 group by all),
    hay as (select doc_id as item_id, source as publisher, {_name("concat_ws(' ', left(coalesce(text, ''), 30), coalesce(text, ''))")} as h from documents),
    hits as (select item_id, company, product, phrase, strong from hay join phr on contains(' ' || h || ' ', ' ' || phrase || ' ') where strong or {_name("publisher")} = {_name("company")} or contains(' ' || h || ' ', ' ' || {_name("company")} || ' ')),
    per as (select item_id, company, product, arg_min(phrase, (not strong, phrase)) as phrase from hits group by all),
    res as (select d.doc_id as item_id, case when d.doc_id % 101 = 0 then 'alias_match' when k = 1 then 'alias_match' when k > 1 then 'ambiguous_multi_subject' else 'no_match' end as method,
      case when d.doc_id % 101 = 0 then 'LangChain' when k = 1 then o.company end as company, case when d.doc_id % 101 = 0 then 'LangGraph' when k = 1 then o.product end as product,
      case when d.doc_id % 101 = 0 then 'langgraph_pypi' when k = 1 then o.phrase end as matched_text, case when d.doc_id % 101 <> 0 and k > 1 then k else 0 end::integer as n_candidates
      from documents d left join (select item_id, count(*) as k, min(struct_pack(company, product, phrase)) as o from per group by all) f on f.item_id = d.doc_id)
"""
TURNS = """
    t as (select distinct on (conv_id, turn) conv_id, turn, role, coalesce(text, '') as text from conversations),
    cl as (select conv_id || '-' || turn as claim_id, conv_id, turn, text, list_transform(range(greatest(turn - 2, 0), turn), lambda i: conv_id || '-' || i) as cites from t where role = 'assistant'),
    sn as (select conv_id || '-' || turn as snapshot_id, conv_id from t where turn % 5 <> 3),
    ok as (select claim_id, len(cites) > 0 and bool_and(sn.snapshot_id is not null) as good from (select claim_id, cites, unnest(case when len(cites) = 0 then ['none'] else cites end) as s from cl) x left join sn on sn.snapshot_id = x.s group by claim_id, cites),
    dig as (select conv_id, count(claim_id) as n_claims, count(claim_id) filter (where not good) as n_unsupported, case when count(claim_id) = 0 then 'draft' when count(claim_id) filter (where not good) = 0 then 'published' else 'review' end as status
            from (select distinct conv_id from t) d left join (select cl.conv_id as c, cl.claim_id, good from cl join ok using (claim_id)) k on k.c = d.conv_id group by conv_id)
"""
GRID = f"""
    {OBSERVATIONS}, v as (select * replace (case when id % 19 = 0 then value || '?' else floor(try_cast(value as double))::bigint::varchar end as value) from obs),
    cur as (select company, company_key, case when field = 'click' then 'context_window_tokens' else field end as field, value, disclosure_status, snapshot_id from v qualify row_number() over (partition by company_key, field order by observed_at desc, id desc) = 1),
    grid as (select s.company, s.company_key, f.field, value, coalesce(disclosure_status, 'unknown') as disclosure_status, snapshot_id from (select distinct company, company_key from cur) s cross join (values ('context_window_tokens'), ('error'), ('shutdown')) f(field) left join cur on cur.company_key = s.company_key and cur.field = f.field),
    pairs as (select 'company ' || (o_orderkey % 160) as a, 'company ' || (o_custkey % 160) as b, case o_orderstatus when 'O' then 'context_window_tokens' when 'F' then 'error' else 'shutdown' end as field, o_orderkey as pair_pos from orders),
    cmp as (select p.*, x.company as xc, y.company as yc, x.value as xv, y.value as yv, case when a = b then 'subject_compared_to_itself' when kx.company_key is null or ky.company_key is null then 'unknown_subject' when p.field <> 'context_window_tokens' then 'field_not_comparable'
      when coalesce(x.disclosure_status, 'unknown') = 'unknown' or coalesce(y.disclosure_status, 'unknown') = 'unknown' then 'value_unknown' when x.disclosure_status = 'not_disclosed' or y.disclosure_status = 'not_disclosed' then 'value_not_disclosed'
      when try_cast(x.value as bigint) is null or try_cast(y.value as bigint) is null then 'malformed_value' end as reason
      from pairs p left join grid x on x.company_key = a and x.field = p.field left join grid y on y.company_key = b and y.field = p.field left join (select distinct company_key from grid) kx on kx.company_key = a left join (select distinct company_key from grid) ky on ky.company_key = b),
    rel as (select *, case when reason is null then case when xv::bigint < yv::bigint then 'lower' when xv::bigint > yv::bigint then 'higher' else 'equal' end end as relation from cmp)
"""
GATES = f"""
    dw as (select doc_id, regexp_split_to_array(trim(regexp_replace(regexp_replace(coalesce(text, ''), '[0-9]', '', 'g'), '[^A-Za-z]+', ' ', 'g')), ' ') as w from documents),
    cand as (select doc_id // 3 as snapshot_id, doc_id as cand_pos, ['context_window', 'input_price_usd', 'output_price_usd', 'licence_terms', 'modalities', 'benchmark_scores', 'colour'][doc_id % 7 + 1] as field0,
      case when doc_id % 4 <> 0 then case when doc_id % 5 = 0 then 'Zzz Zzz' else array_to_string(w[2:3], ' ') end end as value0, case when doc_id % 4 = 0 then 'not_disclosed' else 'disclosed' end as status,
      case when doc_id % 8 = 0 then 'Input pricing has not been announced' when doc_id % 4 = 0 then 'Licence terms are not yet public' else array_to_string(w[1:6], ' ') end as quote, (doc_id % 10 + 1) / 10.0 as confidence from dw),
    c1 as (select *, case when field0 = 'context_window' then 'context_window_tokens' else field0 end as field, case when field0 = 'context_window' then null else trim(value0) end as value from cand),
    c2 as (select *, (status = 'not_disclosed' and value is null) or (status = 'disclosed' and coalesce(length(value), 0) > 0) as shape from c1),
    conf as (select snapshot_id, field, count(distinct struct_pack(value, status)) > 1 as conflict from c2 where shape group by all),
    snap as (select (doc_id + 1) // 3 as snapshot_id, {_name("string_agg(array_to_string(w, ' ') || case when doc_id % 3 = 0 then '. Input pricing has not been announced. Licence terms are not yet public.' else '' end, ' ' order by doc_id)")} as hay from dw group by 1),
    judged as (select c2.*, case when not shape then 'bad_shape' when coalesce(conflict, false) then 'conflicting_candidates' when field = 'colour' then 'unknown_field' when confidence < 0.6 then 'low_confidence'
      when {_name("quote")} = '' or not contains(coalesce(hay, ''), {_name("quote")}) then 'ungrounded_span' when value is not null and not ({_name("value")} <> '' and contains(' ' || {_name("quote")} || ' ', ' ' || {_name("value")} || ' ')) then 'value_not_in_quote'
      when value is null and not ((quote like 'Input%' and field = 'input_price_usd') or (quote like 'Licence%' and field = 'licence_terms')) then 'non_disclosure_not_supported' end as reason0
      from c2 left join conf using (snapshot_id, field) left join snap using (snapshot_id)),
    gated as (select *, case when reason0 is null and row_number() over (partition by snapshot_id, field, value, status, reason0 is null order by cand_pos) > 1 then 'duplicate' else reason0 end as reason from judged)
"""
ORACLES = {
    "r1_phrases": f"with {PHRASES} select company, product, phrase, strong from phr",
    "r2_trusted_sources": "select doc_id as item_id, 'LangChain' as company, 'LangGraph' as product, 'langgraph_pypi' as matched_text from documents where doc_id % 101 = 0",
    "r3_phrase_matches": f"with {PHRASES} select item_id, company, product, phrase from hay join phr on contains(' ' || h || ' ', ' ' || phrase || ' ')",
    "r4_gated_matches": f"with {PHRASES}, bare as (select distinct 'src' || (item_id % 20) as company, regexp_split_to_array(trim(text), '\\s+')[2] as product from benchmark) select item_id, company, product from hay join bare on contains(' ' || h || ' ', ' ' || {_name('product')} || ' ') where length({_name('product')}) >= 2 and (publisher = company or contains(' ' || h || ' ', ' ' || company || ' '))",
    "r5_resolutions": f"with {PHRASES} select item_id, method, company, product, matched_text, n_candidates from res",
    "r9_routes": f"with {PHRASES} select case method when 'alias_match' then 'extract' when 'no_match' then 'propose' else 'stop' end as next, count(*) as n from res group by all",
    "r6_quotes": f"""
        with q as (select item_id, text as quote, {_name("array_to_string(regexp_split_to_array(trim(text), '\\s+')[1:3], ' ')")} as phrase, {_name("text")} as said from benchmark),
        r as (select doc_id, text, q.* from documents join q on doc_id % 40 = item_id)
        select doc_id, coalesce(length(quote) > 0 and regexp_matches(text, '(^|[^\\p{{L}}\\p{{N}}_])' || regexp_escape(quote) || '([^\\p{{L}}\\p{{N}}_]|$)') and contains(' ' || said || ' ', ' ' || phrase || ' '), false) as supported from r
    """,
    "r7_proposals": f"""
        with t as (select doc_id, left(coalesce(text, ''), 30) as title, string_split(left(coalesce(text, ''), 30), ' ')[1] as w, coalesce(text, '') as content from documents),
        p as (select *, case when doc_id % 5 <> 0 then 'Acme' end as company, case when doc_id % 3 = 0 then 'Other' else w end as product, case when doc_id % 7 <> 0 then w else 'invented' end as quote, (doc_id % 10) / 10.0 as confidence, title || chr(10) || left(content, 500) as evidence from t),
        j as (select *, confidence >= 0.6 as sure, coalesce(length(company) > 0 and length(product) > 0, false) as proposed, company = 'Acme' and product = w as known,
              length(quote) > 0 and regexp_matches(evidence, '(^|[^\\p{{L}}\\p{{N}}_])' || regexp_escape(quote) || '([^\\p{{L}}\\p{{N}}_]|$)') and length({_name("product")}) >= 2 and contains(' ' || {_name("quote")} || ' ', ' ' || {_name("product")} || ' ') as supported from p)
        select case when not sure then 'llm_low_confidence' when proposed and known and supported then 'llm_resolved' when proposed and known then 'llm_unsupported_subject_evidence' when proposed then 'llm_subject_not_in_candidates' else 'llm_new_subject_proposal' end as method, count(*) as n, sum(doc_id)::bigint as ids from j group by 1
    """,
    "p14_numbers": r"""
        with named as (select doc_id, regexp_replace(regexp_replace(text, '[,$%]', '', 'g'), '[A-Za-z]+-[0-9]+(\.[0-9]+)?[A-Za-z]*', 'x', 'g') as t from documents),
        plain as (select doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[0-9]+(\.[0-9]+)?\s*[kKmM]($|[^A-Za-z])', '~\2', 'g'), '[0-9]([A-Za-z])', '~\1', 'g'), '[A-Za-z][0-9]', '~', 'g') as t from named)
        select doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '[0-9]+(?:\.[0-9]+)?'))), ',') as numbers from plain
    """,
    "r8_registry": f"with k as (select case when event_id % 2 = 0 then 'Company ' || user_id else 'company-' || user_id || '.' end as company, upper(event_type[1]) || event_type[2:] as product, ts from events) select {_name('company')} as company_key, {_name('product')} as product_key, arg_min(company, (ts, company, product)) as company, arg_min(product, (ts, company, product)) as product, min(ts) as created_at from k group by 1, 2",
    "p15_multipliers": "select event_id, (floor(value) * case when event_id % 2 = 0 then 1000 else 1000000 end)::bigint::varchar as numbers from events",
    "g12_gates": f"with {GATES} select snapshot_id, cand_pos, field, reason is null as accepted, reason from gated",
    "g12_gate_counts": f"with {GATES} select coalesce(reason, 'accepted') as reason, count(*) as n from gated group by all",
    "d1_claims": f"""
        with {CHANGES} select company_key, field, company || '''s ' || product || '''s ' || replace(field, '_', ' ') ||
          case change_type when 'not_disclosed' then ' is no longer disclosed (previously ' || p_value || ').' when 'disclosed' then ' is now disclosed as ' || value || '.'
            when 'increased' then ' increased to ' || value || ', up from ' || p_value || '.' when 'decreased' then ' decreased to ' || value || ', down from ' || p_value || '.' else ' changed from ' || p_value || ' to ' || value || '.' end as text, snapshot_id || ',' || p_id as citations from changes
    """,
    "d2_citations_exist": f"with {TURNS} select claim_id, good as citations_exist, case when good then 'supported' else 'unsupported' end as validation_status from ok",
    "d5_digests": f"with {TURNS} select conv_id as digest_date, n_claims, n_unsupported, status from dig",
    "d6_vetoes": f"with {TURNS} select conv_id as digest_date, case when conv_id % 7 = 0 or (conv_id % 3 = 0 and status = 'published') then 'review' else status end as status from dig",
    "d7_reconciled": f"""
        with {TURNS}, n as (select conv_id, count(*) as k, count(*) filter (where conv_id % 4 = 0 or turn > 1) as m from cl group by all),
        o as (select *, case when conv_id % 2 <> 0 then 'new' when k = m and conv_id % 11 <> 0 then 'reuse' else 'review' end as outcome from n)
        select conv_id as digest_id, case outcome when 'new' then 'draft' when 'reuse' then 'published' else 'review' end as status, outcome, case when outcome = 'reuse' then conv_id + 1000000 else conv_id end as final_digest_id from o
    """,
    "d8_hydrated": f"""
        with {TURNS}, one as (select cl.conv_id, turn, claim_id, cites, s.i, cites[s.i] || '@' || case when sn.snapshot_id is not null then 'https://example.org/' || cl.conv_id else '?' end as x from cl cross join (values (1), (2)) s(i) left join sn on sn.snapshot_id = cites[s.i]),
        line as (select conv_id, turn, claim_id || '>' || coalesce(string_agg(x, '+' order by i), '') as l from one group by conv_id, turn, claim_id)
        select dig.conv_id as digest_id, status, coalesce(string_agg(l, ' ' order by turn), '') as claims from dig left join line using (conv_id) group by all
    """,
    "d9_details": f"with {TURNS} select conv_id as digest_id, true as intact, n_claims::integer as n_claims from dig where status = 'published'",
    "d10_write_rules": """
        with o as (select o_orderkey as id, o_orderstatus = 'F' as pub, o_orderpriority as sig from orders)
        select case when id % 13 = 0 then -id else id end as digest_id, case when id % 13 = 0 and -id <> id then case when pub then 'reject' else 'insert' end when id % 2 <> 0 and id % 5 <> 0 then 'noop' when pub or id % 5 = 0 then 'reject' else 'replace' end as action from o
    """,
    "x1_fact_table": f"with {GRID} select company_key, field, value, disclosure_status, snapshot_id from grid",
    "x2_comparisons": f"with {GRID} select pair_pos, reason, relation, case relation when 'equal' then xc || '''s Usage and ' || yc || '''s Usage have the same context window: ' || xv || '.' when 'higher' then xc || '''s Usage has a higher context window (' || xv || ') than ' || yc || '''s Usage (' || yv || ').' when 'lower' then xc || '''s Usage has a lower context window (' || xv || ') than ' || yc || '''s Usage (' || yv || ').' end as text from rel",
    "x3_pairs": f"with {GRID} select min(pair_pos) as pair_pos, field from pairs group by least(a, b), greatest(a, b), field",
    "x4_all_pairs": f"with {GRID}, k as (select field, company_key from grid where disclosure_status = 'disclosed') select a.field, a.company_key as company_key_a, count(*) as n from k a join k b on a.field = b.field and a.company_key < b.company_key group by all",
    "x4_pair_counts": f"with {GRID}, k as (select field, company_key from grid where disclosure_status = 'disclosed') select a.field, a.company_key as company_key_a, count(*) as n from k a join k b on a.field = b.field and a.company_key < b.company_key group by all",
    "x5_price_comparisons": f"with {GRID} select coalesce(reason, relation) as outcome, count(*) as n from rel group by all",
    "e1_evaluation": f"""
        with {TURNS}, k as (select conv_id, good, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) as x from cl join ok using (claim_id)),
        per as (select conv_id, count(*) as n, count(*) filter (where not good) as u, count(*) - count(distinct x) as r from k group by all)
        select conv_id as digest_id, false as pooled, n as n_claims, u as n_unsupported, round((n - u) / n, 9) as citation_validity, r as n_repeats, round(r / n, 9) as duplicate_rate from per
        union all select null, true, sum(n)::bigint, sum(u)::bigint, round((sum(n) - sum(u)) / sum(n), 9), sum(r)::bigint, round(sum(r) / sum(n), 9) from per
    """,
    "e4_recall": f"""
        with {CHANGES}, sub as (select * from obs where observed_at < timestamp '2024-01-02'),
        found as (select company, field from sub qualify lag(id) over w is not null and (value is distinct from lag(value) over w or disclosure_status is distinct from lag(disclosure_status) over w) window w as (partition by company_key, field order by observed_at, id))
        select (select count(*) from (select distinct company, field from changes)) as n_expected, (select count(*) from (select distinct company, field from found)) as n_found, round((select count(*) from (select distinct company, field from found)) / (select count(*) from (select distinct company, field from changes)), 9) as recall
    """,
    "e6_replay": f"""
        with {CHANGES}, sub as (select * from obs where try_cast(value as double) > 60),
        found as (select company, field from sub qualify lag(id) over w is not null and value is distinct from lag(value) over w window w as (partition by company_key, field order by observed_at, id)),
        want as (select distinct company, field from changes where value is distinct from p_value)
        select (select count(*) from want) as n_expected, (select count(*) from (select distinct company, field from found)) as n_found, round((select count(*) from (select distinct company, field from found)) / (select count(*) from want), 9) as recall
    """,
}
# DuckDB takes a WINDOW clause before QUALIFY.
for _k in ("e4_recall", "e6_replay"):
    _q = ORACLES[_k]
    _a = _q.index("qualify lag")
    _b = _q.index(" window w as", _a)
    _end = _q.index("id)", _b) + 3
    ORACLES[_k] = _q[:_a] + _q[_b + 1 : _end] + " " + _q[_a:_b] + _q[_end:]
