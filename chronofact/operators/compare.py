"""Comparisons of subjects field by field. Rows have: company, product, company_key, product_key, field, value,
disclosure_status, snapshot_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofact.functions.text import field_label, parse_int, parse_price
from chronofact.operators.ordered import scanned, with_position

#: Fields with a registered rule: how their values are read.
RULES = {"context_window_tokens": parse_int}
#: A rule for prices, which is registered only where a caller says that all prices have one basis.
PRICE_RULES = {"input_price_usd": parse_price, "output_price_usd": parse_price}


def fact_table(subjects: DataFrame, fields: list[str], current: DataFrame) -> DataFrame:
    """Every subject with every field; where there is no fact, the status is unknown."""
    grid = subjects.select("company", "product", "company_key", "product_key").distinct().withColumn("field", F.explode(F.array(*[F.lit(f) for f in fields])))
    facts = current.select("company_key", "product_key", "field", "value", "disclosure_status", "snapshot_id")
    return grid.join(facts, ["company_key", "product_key", "field"], "left").withColumn("disclosure_status", F.coalesce("disclosure_status", F.lit("unknown")))


def dedupe_reversed_pairs(pairs: DataFrame) -> DataFrame:
    """(company_key_a, product_key_a, company_key_b, product_key_b, field, pair_pos): the first of each unordered pair and field."""
    a, b = (F.struct(F.col(f"company_key_{s}").alias("c"), F.col(f"product_key_{s}").alias("p")) for s in "ab")
    w = Window.partitionBy(F.least(a, b), F.greatest(a, b), "field").orderBy("pair_pos")
    return pairs.withColumn("_no", F.row_number().over(w)).where("_no = 1").drop("_no")


def pair_lists(grid: DataFrame, blocks: int = 16, listed: int = 1024) -> DataFrame:
    """``all_pairs`` without a row for each: company_key_a, product_key_a, field and ``others``, up to ``listed`` subjects b
    (structs of company_key and product_key) that pair with a.

    A field's subjects are put in order and cut into lists. A subject meets the rest of its own list and every later list
    whole, so there are ``listed`` times fewer rows than pairs and no pair is compared. The lists are dealt to ``blocks``
    tasks a field, and each subject is copied to all of them. Equal rows of a subject pair as often as they stand.
    """
    rows = grid.where("disclosure_status = 'disclosed'").groupBy("field", "company_key", "product_key").agg(F.count("*").cast("int").alias("_times"))
    placed = with_position(rows, [F.asc("field"), F.asc("company_key"), F.asc("product_key")], "_at")
    placed = placed.select("field", F.struct("company_key", "product_key").alias("s"), "_times", "_at", F.expr(f"_at div {listed}").alias("_i"))
    # How many of its list stand up to the subject itself.
    upto = F.sum("_times").over(Window.partitionBy("field", "_i").orderBy("_at")).cast("int")
    left = placed.withColumn("_upto", upto).select("field", F.col("s").alias("a"), "_i", "_upto", F.explode(F.flatten(F.array_repeat(F.sequence(F.lit(0), F.lit(blocks - 1)), F.col("_times")))).alias("_b"))
    lists = placed.groupBy("field", F.col("_i").alias("_j")).agg(F.array_sort(F.collect_list(F.struct("_at", F.array_repeat("s", F.col("_times")).alias("same")))).alias("_in")).select("field", "_j", F.flatten("_in.same").alias("others")).withColumn("_b", F.pmod("_j", F.lit(blocks)).cast("int"))
    met = left.join(lists.hint("merge"), ["field", "_b"]).where("_i < _j or (_i = _j and _upto < size(others))")
    rest = F.when(F.col("_i") < F.col("_j"), F.col("others")).otherwise(F.slice("others", F.col("_upto") + 1, F.lit(1 << 30)))
    return met.select(F.col("a.company_key").alias("company_key_a"), F.col("a.product_key").alias("product_key_a"), "field", rest.alias("others"))


def all_pairs(grid: DataFrame, blocks: int = 16) -> DataFrame:
    """Every unordered pair of subjects that disclose a field, by the field: as rows they are quadratic in subjects.

    They are the ``pair_lists`` written out. Where counts are all that is asked, ``pair_counts`` makes no pairs.
    """
    pairs = pair_lists(grid, blocks).select("company_key_a", "product_key_a", F.explode("others").alias("b"), "field")
    return pairs.select("company_key_a", "product_key_a", F.col("b.company_key").alias("company_key_b"), F.col("b.product_key").alias("product_key_b"), "field")


def pair_counts(grid: DataFrame) -> DataFrame:
    """How many of ``all_pairs`` each subject begins, by the field, told from its rank without a pair -> company_key, product_key, field, n.

    Equal rows of a subject and field count as often as they do; subjects that begin no pair are left out.
    """
    rows = grid.where("disclosure_status = 'disclosed'").groupBy("field", "company_key", "product_key").agg(F.count("*").alias("_times"))
    placed = with_position(rows, [F.asc("field"), F.asc("company_key"), F.asc("product_key")], "_at")
    # Blocks of places, so that a field of nearly all subjects isn't summed in one task.
    summed = scanned(placed, ["field"], ["_at"], F.expr("_at div 100000"), total={"_upto": F.col("_times")})
    whole = rows.groupBy("field").agg(F.sum("_times").alias("_all"))
    return summed.join(whole, "field").select("company_key", "product_key", "field", (F.col("_times") * (F.col("_all") - F.col("_upto"))).alias("n")).where("n > 0")


def compare_pairs(pairs: DataFrame, grid: DataFrame, rules: dict | None = None) -> DataFrame:
    """Each pair -> reason (the first against it) or relation of a to b: lower, higher, equal; and the sentence."""
    rules = RULES if rules is None else rules
    subjects = grid.select("company_key", "product_key").distinct()
    rows = pairs
    for s in "ab":
        rows = rows.join(subjects.select(F.col("company_key").alias(f"company_key_{s}"), F.col("product_key").alias(f"product_key_{s}"), F.lit(True).alias(f"_known_{s}")), [f"company_key_{s}", f"product_key_{s}"], "left")
        side = grid.select(F.col("company_key").alias(f"company_key_{s}"), F.col("product_key").alias(f"product_key_{s}"), "field", F.struct("company", "product", "value", "disclosure_status", "snapshot_id").alias(f"_{s}"))
        rows = rows.join(side, [f"company_key_{s}", f"product_key_{s}", "field"], "left")

    def parsed(s: str) -> Column:
        out = F.lit(None).cast("decimal(38,9)")
        for field, rule in rules.items():
            out = F.when(F.col("field") == field, rule(F.col(f"_{s}.value")).cast("decimal(38,9)")).otherwise(out)
        return out

    def status(s: str) -> Column:
        return F.coalesce(f"_{s}.disclosure_status", F.lit("unknown"))

    x, y = parsed("a"), parsed("b")
    reason = (
        F.when((F.col("company_key_a") == F.col("company_key_b")) & (F.col("product_key_a") == F.col("product_key_b")), F.lit("subject_compared_to_itself"))
        .when(F.col("_known_a").isNull() | F.col("_known_b").isNull(), F.lit("unknown_subject"))
        .when(~F.col("field").isin(*rules) if rules else F.lit(True), F.lit("field_not_comparable"))
        .when((status("a") == "unknown") | (status("b") == "unknown"), F.lit("value_unknown"))
        .when((status("a") == "not_disclosed") | (status("b") == "not_disclosed"), F.lit("value_not_disclosed"))
        .when(F.col("_a.value").isNull() | F.col("_b.value").isNull(), F.lit("value_unknown"))
        .when(F.col("_a.snapshot_id").isNull() | F.col("_b.snapshot_id").isNull(), F.lit("ungrounded_citation"))
        .when(x.isNull() | y.isNull(), F.lit("malformed_value"))
    )
    rows = rows.withColumn("reason", reason)
    relation = F.when(F.col("reason").isNull(), F.when(x < y, F.lit("lower")).when(x > y, F.lit("higher")).otherwise(F.lit("equal")))
    rows = rows.withColumn("relation", relation)
    return rows.select(*pairs.columns, "reason", "relation", F.when(F.col("relation").isNotNull(), sentence(F.col("_a"), F.col("_b"), F.col("field"), F.col("relation"))).alias("text"))


def sentence(a: Column, b: Column, field: Column, relation: Column) -> Column:
    """The sentence of a comparison, from looked-up values only."""
    name = {k: F.concat(s["company"], F.lit("'s "), s["product"]) for k, s in (("a", a), ("b", b))}
    label = field_label(field)
    same = F.concat(name["a"], F.lit(" and "), name["b"], F.lit(" have the same "), label, F.lit(": "), a["value"], F.lit("."))
    other = F.concat(name["a"], F.lit(" has a "), relation, F.lit(" "), label, F.lit(" ("), a["value"], F.lit(") than "), name["b"], F.lit(" ("), b["value"], F.lit(")."))
    return F.when(relation == "equal", same).otherwise(other)
