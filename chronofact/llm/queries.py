"""The registered queries of the numbered operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofact.llm.byte_bpe import byte_bpe
from chronofact.llm.conversations import repair_conversations
from chronofact.llm.embedding_dedup import embedding_groups
from chronofact.llm.exact_dedup import exact_dedup
from chronofact.llm.packing import pack_documents
from chronofact.llm.periodic_runs import periodic_runs
from chronofact.llm.pieces import sentence_pieces
from chronofact.llm.secrets import scan_secrets
from chronofact.llm.simhash import simhash_groups
from chronofact.llm.substring_dedup import substring_dedup
from chronofact.llm.token_files import token_file_digest
from chronofact.llm.toxicity import toxicity
from chronofact.llm.url_filters import filter_urls, rule_table

#: (host, path, action)
URL_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url."""
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rule_table(spark, URL_RULES)).select("page_id", "host", "path", "rule", "verdict")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), chars=6_000_000, cached=300_000)


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of every vector."""
    return embedding_groups(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op4_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, read back from token files."""
    return token_file_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op5_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    done = byte_bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def held_out():
    """Rows whose labels are never learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out())


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of equal texts."""
    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and group."""
    return simhash_groups(table(spark, sf_dir, "documents"), words_in_shingle=3, distance=2)


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets."""
    found = scan_secrets(table(spark, sf_dir, "documents"))

    def joined(kinds):
        return F.concat_ws(",", F.transform(F.filter("spans", lambda s: s["kind"].isin(*kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = ("assign", "access", "hex")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in base), F.sha2(joined(base), 256).alias("base_sha256"), joined((*base, "random")).alias("spans"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words that no smaller document has in a window of 50."""
    return substring_dedup(table(spark, sf_dir, "documents"), window=50).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with planted faults, chosen by each turn's crc32: left out, emptied, unended, repeated, or the user's."""
    turns = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = turns.withColumn("h", F.crc32(key.cast("binary")) % 20).where("h <> 0")
    text = F.when(F.col("h") == 1, F.lit("")).when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("h") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("h") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("copy"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found, repaired = repair_conversations(damaged(turns))
    lines = F.array_join(F.transform("turns", lambda t: F.concat_ws(":", t["role"], t["text"])), "\n")
    parts = repaired.where(F.size("turns") > 0).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", lines.alias("lines")))).alias("parts"))
    texts = parts.select(F.col("conv_id").alias("c"), F.array_join("parts.lines", "\n").alias("text"))
    every = turns.select("conv_id").distinct()
    out = every.join(found.withColumnRenamed("conv_id", "f"), F.col("conv_id").eqNullSafe(F.col("f")), "left").join(texts, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("repaired_sha256"))


def periodic(docs: DataFrame) -> DataFrame:
    """Documents of which a tenth, chosen by crc32, goes over into a repeated passage."""
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = rows.withColumn("g", F.expr("h div 10")).withColumn("words", words).withColumn("n", F.size("words"))
    # Integer division: the passage of p words begins at word a.
    rows = rows.withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    passage = F.expr("slice(words, cast(a as int) + 1, cast(p as int))")
    tail = F.flatten(F.array_repeat(passage, F.expr("cast((n - a) div p + 1 as int)")))
    planted = F.concat(F.expr("slice(words, 1, cast(a as int))"), F.slice(tail, F.lit(1), F.expr("cast(n - a as int)")))
    return rows.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's periodic runs, with passages that repeat planted in a tenth."""
    found = periodic_runs(periodic(table(spark, sf_dir, "documents")))
    first = F.expr("aggregate(runs, cast(null as struct<start:long,length:long,period:long>), (b, r) -> if(b is null or r.length > b.length, r, b))")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.withColumn("longest", first)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "longest.start",
        "longest.length",
        "longest.period",
        F.expr("1000 * longest.length div longest.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded to pieces and decoded."""
    done = sentence_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_best_fit_packing,
        op3_embedding_near_dedup,
        op4_token_id_output,
        op5_byte_level_bpe,
        op6_toxicity,
        op7_exact_dedup,
        op8_simhash_near_dedup,
        op9_secret_scans,
        op10_substring_dedup,
        op11_conversation_repair,
        op12_periodic_runs,
        op13_sentence_pieces,
    )
}

#: crc32 in SQL: a table for bytes, then a fold over the characters of an ASCII text.
CRC_TABLE = "crc as (select list(list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as tab from (select unnest(range(256)) as i))"


def crc32_sql(text: str) -> str:
    """SQL of the crc32 of an ASCII text, beside the table crc."""
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


ORACLES: dict[str, str] = {
    "op1_url_filters": r"""
        with rules(h, p, action) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
        parts as (
          select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages
        ), split as (
          select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts
        ), best as (
          select page_id, arg_max(h || p, length(h || p)) as rule, arg_max(action, length(h || p)) as action
          from split join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id
        )
        select page_id, host, path, rule, coalesce(action, 'allow') as verdict from split left join best using (page_id)
    """,
    "op3_embedding_near_dedup": """
        with recursive e as (
          select vec_id, label, embedding::double[] as v from embeddings
          where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links as (
          select a.vec_id as u, b.vec_id as v from e a join e b on a.label = b.label and len(a.v) = len(b.v) and a.vec_id <> b.vec_id
          where list_cosine_similarity(a.v, b.v) >= 0.98
        ), reached as (
          select vec_id, vec_id as other from embeddings union select r.vec_id, l.v from reached r join links l on l.u = r.other
        ), counts as (select u, count(*) as n from links group by u)
        select vec_id, coalesce(any_value(n), 0) as n_links, min(other) as component_id, min(other) = vec_id as kept
        from reached left join counts on u = vec_id group by vec_id
    """,
    "op7_exact_dedup": """
        with t as (select doc_id, coalesce(text, '') as x from documents),
        g as (select x, max(doc_id) as keep_id, count(*) as group_size from t group by x)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(x) as text_sha256 from t join g using (x)
    """,
    "op10_substring_dedup": r"""
        with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
        win as (select doc_id, s, list_aggregate(ws[s:s + 49], 'string_agg', ' ') as x from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as s from w)),
        firsts as (select x, min(doc_id) as first_id from win group by x),
        hit as (select doc_id, list(s) as starts from win join firsts using (x) where doc_id > first_id group by doc_id),
        gone as (select doc_id, list(distinct i) as places from (select doc_id, unnest(range(s, s + 50)) as i from (select doc_id, unnest(starts) as s from hit)) group by doc_id)
        select w.doc_id, len(ws) as n_words, coalesce(len(places), 0) as n_removed,
               sha256(coalesce(list_aggregate(list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda z: places is null or not list_contains(places, z[2])), lambda z: z[1]), 'string_agg', ' '), '')) as kept_sha256
        from w left join gone using (doc_id)
    """,
    "op11_conversation_repair": f"""
        with recursive {CRC_TABLE},
        told as (
          select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc32_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as h
          from conversations, crc
        ), damaged as (
          select conv_id, turn, case when h = 4 then 'user' else role end as role, case when h = 1 then '' when h = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
                 unnest(range(case when h = 0 then 0 when h = 3 then 2 else 1 end)) as copy
          from told
        ), numbered as (
          select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(length(role) || ':' || role || text), copy) as i from damaged
        ), faulty as (
          select *, left(role, 1) as own, lag(left(role, 1)) over (partition by conv_id order by i) as before,
                 case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
                      when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') then 'truncated' else '' end as fault
          from numbered
        ), shift(st, r, st2) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
        inserts(st, st2, k) as (values (0, 0, 0), (0, 2, 1), (0, 3, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0), (3, 2, 1)),
        edits as (
          select st, own, st as st2, 4 as cost, 'D' as edit from range(4) as s(st), (select distinct own from faulty)
          union all select st, r, st2, 0, 'K' from shift
          union all select st, own, st2, 3, 'R' from shift, (select distinct own from faulty) where r in ('u', 'a') and r <> own
        ), best as (
          select conv_id, 0::bigint as i, st2 as st, struct_pack(cost := 3 * k, audit := repeat('I', k)) as least from (select distinct conv_id from faulty), inserts where st = 0
          union all
          select b.conv_id, f.i, n.st2, min(struct_pack(cost := b.least.cost + d.cost + case when d.edit <> 'D' and fault = 'truncated' then 3 else 0 end + 3 * n.k, audit := b.least.audit || d.edit || repeat('I', n.k)))
          from best b join faulty f on f.conv_id is not distinct from b.conv_id and f.i = b.i + 1
          join edits d on d.st = b.st and d.own = f.own and (d.edit = 'D' or fault not in ('blank', 'duplicate')) join inserts n on n.st = d.st2
          group by b.conv_id, f.i, n.st2
        ), ends as (
          select conv_id, count(*) as n, case when count(turn) > 0 then max(turn) - min(turn) + 1 - count(distinct turn) else 0 end as gaps, count(*) filter (fault = 'blank') as blank,
                 count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated, count(*) filter (before || own not in ('su', 'ua', 'au')) as illegal
          from faulty group by conv_id
        ), chosen as (
          select e.*, (select min(b.least) from best b where b.conv_id is not distinct from e.conv_id and b.i = e.n and b.st in (0, 3)) as c from ends e
        ), letters as (
          select conv_id, j, c.audit[j] as edit, length(replace(c.audit[:j], 'I', '')) as i, length(replace(c.audit[:j], 'D', '')) - 1 - length(replace(c.audit, 'D', '')) % 2 as place
          from (select conv_id, c, unnest(range(1, length(c.audit) + 1)) as j from chosen)
        ), lines as (
          select l.conv_id, string_agg(case when edit = 'K' then role when place % 2 = 0 then 'user' else 'assistant' end || ':' || case when edit = 'I' then '' else text end, chr(10) order by j) as x
          from letters l left join faulty f on f.conv_id is not distinct from l.conv_id and f.i = l.i where edit <> 'D' group by l.conv_id
        )
        select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
               coalesce(c.cost, 0)::bigint as cost, coalesce(c.audit, '') as audit, sha256(coalesce(x, '')) as repaired_sha256
        from (select distinct conv_id from conversations) o left join chosen h on h.conv_id is not distinct from o.conv_id left join lines n on n.conv_id is not distinct from o.conv_id
    """,
    "op12_periodic_runs": f"""
        with {CRC_TABLE},
        told as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws, {crc32_sql("doc_id::varchar")} as h from documents, crc),
        sized as (select *, len(ws) as n, case when len(ws) > 0 then (h // 10) % len(ws) end as a from told),
        docs as (
          select doc_id, n, case when h % 10 = 0 and n > 0 then list_transform(range(n), lambda i: ws[case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) end + 1]) else ws end as ws from sized
        ), lags as (select doc_id, n, ws, unnest(range(1, n // 4 + 1)) as q from docs),
        grid as (select doc_id, q, ws, unnest(range(0, (n - 1) // q - 2)) * q as i from lags),
        hopeful as (select distinct doc_id, q from grid where ws[i + 1] = ws[i + q + 1] and ws[i + 1] = ws[i + 2 * q + 1] and ws[i + 1] = ws[i + 3 * q + 1]),
        same as (select doc_id, q, i from (select doc_id, q, ws, unnest(range(0, n - q)) as i from hopeful join docs using (doc_id)) where ws[i + 1] = ws[i + q + 1]),
        stretches as (select doc_id, q, min(i) as s, max(i) + 1 + q as e from (select *, i - row_number() over (partition by doc_id, q order by i) as g from same) group by doc_id, q, g),
        runs as (select doc_id, s, e - s as length, min(q) as q from stretches where e - s >= greatest(6, 4 * q) group by doc_id, s, e),
        gone as (select doc_id, list(distinct i) as places from (select doc_id, unnest(range(s + q, s + length)) as i from runs) group by doc_id),
        shape as (select doc_id, count(*) as n_runs, min(struct_pack(l := -length, s := s, q := q)) as b, string_agg(s || ',' || length || ',' || q || chr(10), '' order by s, q) as x from runs group by doc_id)
        select doc_id, coalesce(n_runs, 0) as n_runs, b.s as start, -b.l as length, b.q as period, 1000 * -b.l // b.q as exponent_milli, sha256(coalesce(x, '')) as runs_sha256,
               sha256(coalesce(list_aggregate(list_transform(list_filter(list_zip(ws, range(n)), lambda z: places is null or not list_contains(places, z[2])), lambda z: z[1]), 'string_agg', ' '), '')) as collapsed_sha256
        from docs left join gone using (doc_id) left join shape using (doc_id)
    """,
}
