"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Base patterns find spans; long mixed-character runs elsewhere are further candidates. Every
candidate's value is hashed, and hashes are counted by distinct owners and repositories over
the whole corpus: a value that many owners have is a copied example, one that few have looks
live. Runs that look live are added as spans of the kind ``live``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_folder, staged, table

#: Fixed values of the contract, in the order of its kinds.
KINDS = ("assign", "access", "hex")
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
ASSIGN_LEAST = 12
#: A run that may be a credential: long, of upper and lower case or of one case and digits.
RUN = "(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]{20})(?=[a-zA-Z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]++"
#: A value of more owners, or of more repositories, is an example.
MAX_OWNERS, MAX_REPOSITORIES = 2, 50
SALTS = 8
#: Matches of one text that are summed together.
CHUNK = 200
#: Spans of up to this many texts are broadcast to mask them; more are joined by a shuffle.
MASK_BROADCAST_ROWS = 500_000

SPAN = "struct<s:bigint,k:int,e:bigint,h:bigint>"


def spans(text: Column, pattern: str, kind: int, value_group: int = 0) -> Column:
    """Leftmost non-overlapping matches as (start, kind, end, hash of the value); offsets count code points.

    Starts are running sums of the lengths of the pieces between matches and of the matches. Sums run over
    chunks first and then inside each, so that no long array is rebuilt for every match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
    pieces = F.split(text, pattern, -1)
    zero, none = F.lit(0).cast("long"), F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["p"])
        e = s + F.length(x["m"])
        one = F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e"), F.xxhash64(x["v"]).alias("h"))
        kept = F.length(x["v"]) >= ASSIGN_LEAST if value_group else F.lit(True)
        return F.struct(e.alias("at"), F.when(kept, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    def offsets(acc: Column, x: Column) -> Column:
        n = F.aggregate(x, zero, lambda total, y: total + F.length(y["p"]) + F.length(y["m"]))
        return F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    zipped = F.zip_with(found, F.zip_with(values, pieces, lambda v, p: F.struct(v.alias("v"), p.alias("p"))), lambda m, x: F.struct(m.alias("m"), x["v"].alias("v"), x["p"].alias("p")))
    # split gives one piece more than there are matches; its pairing has no match
    matched = F.filter(zipped, lambda x: x["m"].isNotNull())
    cut = lambda m: F.transform(F.sequence(F.lit(1), F.size(m), F.lit(CHUNK)), lambda i: F.slice(m, i, CHUNK))
    starts = lambda chunks: F.aggregate(chunks, F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out")), offsets, lambda acc: acc["out"])
    each = lambda x, at: F.aggregate(x, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    # one-element arrays bind the matches and the chunks, so that each is made once
    chunked = F.transform(F.array(matched), cut)
    out = F.flatten(F.flatten(F.transform(chunked, lambda chunks: F.zip_with(chunks, starts(chunks), each))))
    return F.when(F.regexp_like(text, F.lit(pattern)), out).otherwise(none)


def joined(xs: Column) -> Column:
    name = F.array(*map(F.lit, (*KINDS, "live")))
    return F.array_join(F.transform(xs, lambda x: F.concat_ws(":", F.element_at(name, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def count(xs: Column, kind: int) -> Column:
    return F.size(F.filter(xs, lambda x: x["k"] == kind)).cast("long")


def candidates(df: DataFrame, text: str, owner: str, repository: str) -> DataFrame:
    """Each row's base spans and all runs that may be credentials: (row, doc_id, owner, repository, base, found)."""
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(f"array<{SPAN}>")
    assign = F.when(F.contains(t, F.lit(":")) | F.contains(t, F.lit("=")), spans(t, ASSIGN, 0, 2)).otherwise(none)
    access = F.when(F.contains(t, F.lit("AKIA")), spans(t, ACCESS, 1)).otherwise(none)
    return df.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"),
        F.array_sort(F.concat(assign, access, spans(t, HEX, 2))).alias("base"), spans(t, RUN, len(KINDS)).alias("found"),
    )


def apart(each: DataFrame) -> DataFrame:
    """The spans (row, owner, repository, s, k, e, h) without the runs that overlap a base span of their text, by one sort of a text's spans."""
    base = F.col("k") < len(KINDS)
    order = Window.partitionBy("row")
    before = F.max(F.when(base, F.col("e"))).over(order.orderBy("s").rangeBetween(Window.unboundedPreceding, 0))
    # in falling order the later starts come first, so this frame grows too
    after = F.min(F.when(base, F.col("s"))).over(order.orderBy(F.desc("s")).rangeBetween(Window.unboundedPreceding, -1))
    met = each.withColumn("met", F.coalesce(before > F.col("s"), F.lit(False)) | F.coalesce(after < F.col("e"), F.lit(False)))
    return met.where(base | ~F.col("met")).drop("met")


def ownership(each: DataFrame) -> DataFrame:
    """(h, owners, repositories, live) of every candidate value, from three levels of partial counts, so that a hot value is never gathered."""
    by_owner = each.groupBy("h", "owner", "repository").count().groupBy("h", "owner").agg(F.count("*").alias("r"))
    total = by_owner.groupBy("h").agg(F.count("*").alias("owners"), F.sum("r").alias("repositories"))
    return total.withColumn("live", (F.col("owners") <= MAX_OWNERS) & (F.col("repositories") <= MAX_REPOSITORIES))


def scan(df: DataFrame, folder: str, text: str = "text", owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """Spans of every row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied.

    ``n_live`` counts the spans (base ones too) whose value looks live, ``n_copied`` the base spans with a
    copied value. A null text is empty, a null owner or repository is one of its own name '', and
    repeated rows are scanned as rows of their own; an empty table gives no rows. Columns that aren't named
    are not read. Candidates are staged in the folder.
    """
    cands = staged(candidates(df, text, owner, repository), folder, "candidates")
    some = cands.where((F.size("base") > 0) | (F.size("found") > 0))
    each = staged(apart(some.select("row", "owner", "repository", F.explode(F.concat("base", "found")).alias("x")).select("row", "owner", "repository", "x.*")), folder, "each")
    # classes are as many as values: never broadcast by their file size
    classes = ownership(each).select("h", "live").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    marked = each.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(classes, ["h", "salt"])
    base = F.col("k") < len(KINDS)
    by_row = marked.where(base | F.col("live")).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("s", "k", "e", "h"))).alias("all"), F.count_if("live").alias("n_live"), F.count_if(base & ~F.col("live")).alias("n_copied"),
    )
    out = cands.select("row", "doc_id", "base").join(by_row, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select(
        "doc_id", *[count(F.col("base"), i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce(joined(F.col("all")), F.lit("")).alias("spans"), zero("n_live"), zero("n_copied"),
    )


def replaced(t: Column, parts: Column) -> Column:
    """A text with the spans (k, s, e), sorted by start, replaced by ``[k]``; those that overlap become one, of the first one's kind.

    The text is cut into one piece for each chunk of spans first, so that no span searches its place from the text's start.
    """
    zero, strings = F.lit(0), F.array().cast("array<string>")
    most = lambda xs, at: F.aggregate(xs, at, lambda a, x: F.greatest(a, x["e"]))
    cut = lambda xs: F.transform(F.sequence(F.lit(1), F.size(xs), F.lit(CHUNK)), lambda i: F.slice(xs, i, CHUNK))

    def ends(acc: Column, xs: Column) -> Column:
        return F.struct(most(xs, acc["at"]).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("a"), most(xs, acc["at"]).alias("b")))).alias("out"))

    def rewritten(xs: Column, bounds: Column) -> Column:
        piece = F.substring(t, bounds["a"] + 1, bounds["b"] - bounds["a"])
        start = F.struct(zero.alias("at"), strings.alias("out"))

        def step(piece: Column):
            def one(acc: Column, x: Column) -> Column:
                s, e = x["s"] - bounds["a"], x["e"] - bounds["a"]
                fresh = F.concat(acc["out"], F.array(F.substring(piece, acc["at"] + 1, s - acc["at"]), F.concat(F.lit("["), x["k"], F.lit("]"))))
                return F.struct(F.greatest(acc["at"], e).alias("at"), F.when(s >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

            return one

        return F.array_join(F.flatten(F.transform(F.array(piece), lambda p: F.aggregate(xs, start, step(p), lambda acc: acc["out"]))), "")

    def joined_up(chunks: Column) -> Column:
        bounds = F.aggregate(chunks, F.struct(zero.alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("out")), ends, lambda acc: acc["out"])
        return F.array_join(F.zip_with(chunks, bounds, rewritten), "")

    head = F.array_join(F.transform(F.transform(F.array(parts), cut), joined_up), "")
    return F.concat(head, F.substring(t, most(parts, zero) + 1, F.length(t)))


def masked(docs: DataFrame, folder: str, text: str = "text", owner: str = "source", repository: str = "doc_id", size: str = "n_chars") -> DataFrame:
    """Every row with its spans replaced by ``[kind]`` and its size column, if it has one, set to the new length.

    Overlapping spans are masked as one, by the first one's kind. Rows are joined by id: of rows that repeat an
    id with different texts, each is masked by its own text's spans; null texts stay null.
    """
    key, k, found = F.xxhash64("doc_id", text), "_masked_key", "_masked_spans"
    spans_ = scan(docs.withColumn("doc_id", key), folder, text, owner, repository).where(F.col("spans") != "").select(F.col("doc_id").alias(k), F.col("spans").alias(found)).distinct()
    few = staged(spans_, folder, "spans")
    side = F.broadcast(few) if few.count() <= MASK_BROADCAST_ROWS else few
    parts = F.transform(F.split(found, ","), lambda x: F.struct(F.split(x, ":")[0].alias("k"), F.split(x, ":")[1].cast("int").alias("s"), F.split(x, ":")[2].cast("int").alias("e")))
    clean = replaced(F.col(text), parts)
    out = docs.withColumn(k, key).join(side, k, "left").withColumn(text, F.when(F.col(found).isNull(), F.col(text)).otherwise(clean))
    if size in docs.columns:
        out = out.withColumn(size, F.when(F.col(found).isNull(), F.col(size)).otherwise(F.length(text)).cast(docs.schema[size].dataType))
    return out.select(*docs.columns)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; the source is its owner."""
    return scan(table(spark, sf_dir, "documents"), shared_folder(spark))
