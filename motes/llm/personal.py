"""Personal data: base patterns, proposed spans, gradient-boosted trees and calibrated thresholds.

Only DataFrame functions and Spark ML are used.

1. One pass over the texts finds the base spans (four kinds, with their checks) and the proposals of
   high-recall generators, which may overlap; it keeps short contexts and no text.
2. Proposals whose truth the checks settle (inside a base span of their kind, or failing the check
   of their kind) train boosted trees on format and context features.  All are used, those alike as
   one weighted row.  Trees grown on one half of them judge the other, and this sets the threshold
   of each kind: the lowest that reaches ``precision``.
3. Proposals above their threshold that touch no base span are added, the likeliest of every run of
   overlapping ones.  Base spans always stay.

Places are code points, the end exclusive.  A span's place is the sum of what lies before it, by
windows inside a text.  Null and empty texts have no spans.  Rows alike in id and text are searched
once and all get the result.  Without examples of both truths nothing is added.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motes.llm.common import texts, written

# The kinds in order and their base patterns.  Possessive forms and the look-behinds
# match the same spans without going back over long runs.
KINDS = ["email", "ip", "card", "phone"]
BASE = [
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?+[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]
#: Proposals: kind and pattern.
GENERATORS = [
    (0, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++"),
    (1, r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])"),
    (2, r"(?<![0-9])[0-9]{13,19}(?![0-9])"),
    (2, r"(?<![0-9])[0-9]{4}(?:[\x20-][0-9]{4}){3}(?:[\x20-]?[0-9]{1,3})?(?![0-9])"),
    (3, r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[\x20.-]{0,2}[0-9]{2,4}){2,3}(?![0-9])"),
    (3, r"(?<![0-9+])\([0-9]{3}\)\x20?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
]
FEATURES = ["kind0", "kind1", "kind2", "kind3", "digits", "chars", "groups", "sum10", "octet", "plus", "parens", "dots", "dashes",
            "spaces", "letters", "before_space", "before_digit", "after_space", "after_digit", "after_stop", "left_digits",
            "left_words", "cue"]
CUE = r"(?i)(?:e-?mail|mail|contact|call|tel|phone|fax|mobile|ip|host|server|card|visa|pay|account)\W*$"


def _hits(pattern: str, group: int, text: str, column: str) -> Column:
    """The matches of ``column`` (found before) with the length and edges of the text before each."""
    pieces = F.split(F.col(text), pattern, -1)
    edges = F.transform(pieces, lambda p: F.struct(F.length(p).alias("gap"), F.expr("0").alias("z"), F.right(p, F.lit(24)).alias("left"),
                                                   F.left(p, F.lit(4)).alias("next")))
    zipped = F.transform(F.arrays_zip(F.col(column).alias("s"), edges.alias("e"), F.slice(edges, 2, F.size(F.col(column))).alias("n")),
                         lambda x: F.struct(F.lit(group).alias("g"), x["s"].alias("s"), x["e"]["gap"].alias("gap"),
                                            x["e"]["left"].alias("left"), x["n"]["next"].alias("next")))
    return F.when(F.size(column) > 0, F.filter(zipped, lambda x: x["s"].isNotNull()))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of the text) and all matches of every row."""
    patterns = [*BASE, *[p for _, p in GENERATORS]]
    found = texts(docs).select("doc_id", F.xxhash64("text").alias("row"), "text", *[
        F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m{g}") for g, p in enumerate(patterns)])
    lists = [F.coalesce(_hits(p, g, "text", f"m{g}"),
                        F.lit(None).cast("array<struct<g:int,s:string,gap:int,left:string,next:string>>"),
                        F.array().cast("array<struct<g:int,s:string,gap:int,left:string,next:string>>"))
             for g, p in enumerate(patterns)]
    return written(found.select("doc_id", "row", F.concat(*lists).alias("hits")))


def _luhn(digits: Column) -> Column:
    """The check sum modulo 10 of a string of digits."""
    def term(i):
        d = F.substring(digits, F.length(digits) + 1 - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + term(i)) % 10


def placed(scan: DataFrame) -> DataFrame:
    """A row per match: its place, format and whether it passes the check of its kind."""
    hits = scan.where("size(hits) > 0").dropDuplicates(["doc_id", "row"]).select("doc_id", "row", F.posexplode("hits").alias("i", "h")).select(
        "doc_id", "row", "i", "h.*")
    w = Window.partitionBy("doc_id", "row", "g").orderBy("i")
    start = F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(
        F.sum(F.length("s")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kinds = F.array(*[F.lit(k) for k in [0, 1, 2, 3, *[k for k, _ in GENERATORS]]])
    at = hits.withColumn("start", start).withColumn("end", F.col("start") + F.length("s")).withColumn("kind", F.get(kinds, F.col("g")))
    at = at.withColumn("number", F.regexp_replace("s", "[^0-9]", ""))
    n = F.length("number")
    octet = F.when(F.col("kind") == 1, F.array_max(F.transform(F.split("s", r"\."), lambda p: p.cast("double"))))
    at = at.withColumns({"n": n, "octet": F.coalesce(octet, F.lit(-1.0)),
                         "sum10": F.when((F.col("kind") == 2) & n.between(12, 19), _luhn(F.col("number"))).otherwise(-1)})
    valid = (F.when(F.col("kind") == 0, F.lit(True)).when(F.col("kind") == 1, F.col("octet") <= 255)
             .when(F.col("kind") == 2, F.col("n").between(16, 19) & (F.col("sum10") == 0)).otherwise(F.col("n").between(8, 15)))
    return at.select("doc_id", "row", "g", "kind", "start", "end", "s", "left", "next", "n", "octet", "sum10", valid.alias("valid"))


def features(at: DataFrame) -> DataFrame:
    before, after = F.right("left", F.lit(1)), F.left("next", F.lit(1))

    def count(column, pattern):
        return F.length(F.col(column)) - F.length(F.regexp_replace(column, pattern, ""))

    made = {f"kind{k}": F.col("kind") == k for k in range(4)} | {
        "digits": F.col("n"), "chars": F.length("s"), "groups": F.size(F.split("s", "[^0-9]+")), "plus": F.col("s").startswith("+"),
        "parens": F.col("s").contains("("), "dots": count("s", r"\."), "dashes": count("s", "-"), "spaces": count("s", " "),
        "letters": count("s", "[A-Za-z]"), "before_space": before.rlike(r"^\s?$"), "before_digit": before.rlike("[0-9]"),
        "after_space": after.rlike(r"^\s?$"), "after_digit": after.rlike("[0-9]"), "after_stop": after.rlike("[.,;:!?)]"),
        "left_digits": count("left", "[0-9]"), "left_words": count("left", r"\s"), "cue": F.col("left").rlike(CUE)}
    return at.withColumns({k: v.cast("double") for k, v in made.items()} | {"octet": F.col("octet").cast("double"),
                                                                             "sum10": F.col("sum10").cast("double")})


def judged(at: DataFrame) -> DataFrame:
    """Every proposal with its features, whether it touches no base span, and its truth where the checks settle it."""
    base, proposed = at.where("g < 4"), at.where("g >= 4")
    # The furthest end of a base span that begins no later, and the nearest beginning after.
    ends = base.where("valid").select("doc_id", "row", "kind", "start", "end", F.lit(None).cast("int").alias("g"))
    key = ["doc_id", "row"]
    lines = proposed.select(*key, "kind", "start", "end", "g").unionByName(ends)
    base_end, base_start = F.when(F.col("g").isNull(), F.col("end")), F.when(F.col("g").isNull(), F.col("start"))
    w = Window.partitionBy(*key).orderBy("start")
    same = Window.partitionBy(*key, "kind").orderBy("start")
    seen = lines.select("*", F.max(base_end).over(w.rangeBetween(Window.unboundedPreceding, 0)).alias("till"),
                        F.min(base_start).over(w.rangeBetween(0, Window.unboundedFollowing)).alias("from"),
                        F.max(base_end).over(same.rangeBetween(Window.unboundedPreceding, 0)).alias("own")).where("g is not null")
    return written(features(proposed).join(seen.select(*key, "g", "start", "end", "till", "from", "own"), [*key, "g", "start", "end"]).withColumns({
        "free": (F.coalesce("till", F.lit(0)) <= F.col("start")) & (F.coalesce("from", F.col("end")) >= F.col("end")),
        "truth": F.when(F.coalesce("own", F.lit(0)) >= F.col("end"), 1.0).when(~F.col("valid"), 0.0)}).withColumn(
        "order", F.xxhash64("s", "kind", "start")))


def settled(known: DataFrame) -> DataFrame:
    """All settled proposals, those alike in half, kind, truth and features as one row with their number as ``weight``."""
    return written(known.where("truth is not null").groupBy(
        "kind", F.col("truth").alias("label"), F.expr("pmod(order, 2)").alias("half"), *FEATURES).agg(
        F.count("*").cast("double").alias("weight")))


def added(at: DataFrame, precision: float, trees: int, depth: int) -> DataFrame | None:
    """The proposals that the trees accept, or None without examples of both truths."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    key = ["doc_id", "row"]
    known = judged(at)
    examples = settled(known)
    truths = {(r["half"], r["label"]) for r in examples.select("half", "label").distinct().collect()}  # four rows at most
    if len({label for _, label in truths}) < 2:
        return None
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
    trainer = GBTClassifier(maxIter=trees, maxDepth=depth, seed=3, maxBins=32, weightCol="weight")

    def scored(df, by):
        model = trainer.fit(vectors.transform(by.groupBy("label", *FEATURES).agg(F.sum("weight").alias("weight"))))
        return model.transform(vectors.transform(df)).withColumn("p", vector_to_array("probability")[1])

    # Each half is judged by trees that the other half has grown, so every settled proposal counts.
    grid = [0.5, 0.6, 0.7, 0.8, 0.9, 0.95]
    halves = [scored(examples.where(f"half = {h}"), examples.where(f"half = {1 - h}")).select("kind", "label", "weight", "p")
              for h in (0, 1) if {(1 - h, 0.0), (1 - h, 1.0)} <= truths]
    least = {}
    if halves:
        held = reduce(DataFrame.union, halves).groupBy("kind").agg(*[
            (F.sum(F.when(F.col("p") >= t, F.col("label") * F.col("weight"))) / F.sum(F.when(F.col("p") >= t, F.col("weight")))).alias(f"t{i}")
            for i, t in enumerate(grid)]).collect()  # a row per kind
        least = {r["kind"]: next((t for i, t in enumerate(grid) if (r[f"t{i}"] or 0) >= precision), 2.0) for r in held}
    limit = F.coalesce(*[F.when(F.col("kind") == k, F.lit(t)) for k, t in least.items()], F.lit(grid[-1]))
    good = scored(known.where("free"), examples).where(F.col("p") >= limit)
    order = Window.partitionBy(*key).orderBy("start", "end")
    far = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = good.withColumn("new", F.coalesce((far <= F.col("start")).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(order))
    best = Window.partitionBy(*key, "run").orderBy(F.desc("p"), F.desc(F.col("end") - F.col("start")), "start", "g")
    return runs.withColumn("place", F.row_number().over(best)).where("place = 1").select(*key, "kind", "start", "end")


def found_spans(scan: DataFrame, precision: float = 0.98, trees: int = 12, depth: int = 4) -> DataFrame:
    """(doc_id, row, kind, start, end, base) of every span."""
    at = written(placed(scan))
    spans = at.where("g < 4 and valid").select("doc_id", "row", "kind", "start", "end", F.lit(True).alias("base"))
    more = added(at, precision, trees, depth)
    return spans if more is None else spans.union(more.select("*", F.lit(False)))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def personal_data(docs: DataFrame, **options) -> DataFrame:
    """doc_id, the count of base spans by kind, the hash of the base spans, and all spans, per row."""
    scan = scanned(docs)
    spans = written(found_spans(scan, **options))
    place = F.struct("kind", "start", "end")
    lists = spans.groupBy("doc_id", "row").agg(
        *[F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(_listed(F.collect_list(F.when(F.col("base"), place))).cast("binary"), 256).alias("base_sha256"),
        _listed(F.collect_list(place)).alias("spans"))
    rows = scan.select("doc_id", "row", (F.size("hits") > 0).alias("some"))
    hit = rows.where("some").alias("a").join(
        lists.alias("b"), (F.col("a.row") == F.col("b.row")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), "left")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    counts = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    out = hit.select("a.doc_id", *counts, F.coalesce("base_sha256", empty).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
    return out.union(rows.where("not some").select("doc_id", *[F.lit(0).cast("long") for _ in KINDS], empty, F.lit("")))


def redacted(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans are one, named by the first.

    Columns, whatever their names, and rows are kept; a null text stays null.
    """
    spans = found_spans(scanned(docs), **options)
    key = ["doc_id", "row"]
    order = Window.partitionBy(*key).orderBy("start", "end", "kind")
    far = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("run", F.sum(F.coalesce((far <= F.col("start")).cast("int"), F.lit(1))).over(order))
    whole = runs.groupBy(*key, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "end", "kind")).alias("kind"))
    # What follows each span begins at its end and goes to the next one.
    nxt = F.lead("start").over(Window.partitionBy(*key).orderBy("start"))
    lists = written(whole.withColumn("next", nxt).groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "next", "kind"))).alias("cuts")))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col("own.text")

    def part(x):
        rest = F.when(x["next"].isNull(), F.substring(text, x["end"].cast("int") + 1, F.length(text))).otherwise(
            F.substring(text, x["end"].cast("int") + 1, (x["next"] - x["end"]).cast("int")))
        return F.concat(F.get(names, x["kind"]), rest)

    new = F.concat(F.substring(text, F.lit(1), F.col("b.cuts")[0]["start"].cast("int")), F.array_join(F.transform("b.cuts", part), ""))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"))
    joined = own.alias("a").join(lists.alias("b"), (F.col("a.row") == F.col("b.row")) & F.col("own.doc_id").cast("long").eqNullSafe(F.col("b.doc_id")), "left")
    changed = F.when(F.col("b.cuts").isNull(), text).otherwise(new)
    return joined.select(*[changed.alias("text") if c == "text" else F.col("own").getField(c).alias(c) for c in docs.columns])
