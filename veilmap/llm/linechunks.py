"""Line dedup by content-defined chunks.  Built-in functions only.

The lines of a document are hashed; a rolling hash over neighbouring line hashes chooses
where chunks end, within a smallest and a largest size, so equal passages are cut alike wherever
they stand.  Chunks of several lines that occur before, in any document, are removed once their bytes are compared.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmap.llm.common import KEY, ROW, keyed, row_key
from veilmap.sources.storage import materialize

WINDOW = 2
EVERY = 3
MIN_LINES = 2
# A multiple of short periods, so that cuts fall alike in a periodic text.
MAX_LINES = 12


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chunk_lines(lines: Column, window: int = WINDOW, every: int = EVERY, min_lines: int = MIN_LINES,
                max_lines: int = MAX_LINES) -> Column:
    """array<array<string>>: the lines cut into chunks of at least `min_lines` (if there are so many).

    A cut is possible after line i if the hash of the hashes of lines i-window+1 .. i is 0 modulo
    `every`.  Where possible cuts stand closer than `min_lines`, every `min_lines`-th line from the
    first of them on is cut instead; what is longer than `max_lines` is cut every `max_lines` lines.
    A tail shorter than `min_lines` stays with the chunk before.  Cuts depend on the lines since the
    last gap between possible cuts only, so an inserted line moves few.
    """
    def possible(h):
        return _let(F.size(h), lambda n: F.filter(
            F.sequence(F.lit(1), n),
            lambda i: (i >= max(window, min_lines)) & (i <= n - min_lines) & (F.pmod(F.xxhash64(*[
                F.get(h, i - 1 - back) for back in reversed(range(window))]), F.lit(every)) == 0)))

    def spaced(ends):
        heads = F.filter(ends, lambda e, k: (k == 0) | (e - F.get(ends, k - 1) >= min_lines))
        tails = F.filter(ends, lambda e, k: (k == F.size(ends) - 1) | (F.get(ends, k + 1) - e >= min_lines))
        return _let(tails, lambda last: F.flatten(F.transform(heads, lambda e, k: F.sequence(
            e, F.get(last, k), F.lit(min_lines)))))

    def starts(ends, n):
        return F.flatten(F.transform(F.concat(F.array(F.lit(0)), ends), lambda s, k: F.sequence(
            s, F.greatest(s, F.coalesce(F.get(ends, k), n) - min_lines), F.lit(max_lines))))

    def chunks(x):
        hashes = F.transform(x, lambda line: F.xxhash64(line))
        first = _let(_let(_let(hashes, possible), spaced), lambda ends: starts(ends, F.size(x)))
        return _let(first, lambda at: F.transform(at, lambda s, k: F.slice(
            x, s + 1, F.coalesce(F.get(at, k + 1), F.size(x)) - s)))

    return _let(lines, chunks)


def chunk_hash(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def _chunks(docs: DataFrame, window: int, every: int, min_lines: int, max_lines: int) -> DataFrame:
    """(_key, pos, n, chunk): chunks of every document."""
    cut = docs.select(F.col(KEY), chunk_lines(
        F.split(F.col("text"), "\n", -1), window, every, min_lines, max_lines).alias("chunks"))
    return cut.select(KEY, F.posexplode("chunks").alias("pos", "lines")).select(
        KEY, "pos", F.size("lines").alias("n"), F.array_join("lines", "\n").alias("chunk"))


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW,
                    every: int = EVERY, min_lines: int = MIN_LINES, max_lines: int = MAX_LINES) -> DataFrame:
    """(_key, pos): chunks of at least `min_lines` lines whose bytes occur before, ordered by
    document id, text hash and position.

    The bytes are compared by grouping on them, combined before the shuffle; where a hash stands for
    one byte string, it is enough to find the other places.  Byte strings that share a hash are
    told apart by their bytes.
    """
    base = docs.select(row_key(F.col(id_col), F.col(text)).alias(KEY), F.col(text).alias("text")).where(
        F.col("text").isNotNull())
    every_chunk = _chunks(base, window, every, min_lines, max_lines).where(F.col("n") >= min_lines).withColumn(
        "h", chunk_hash(F.col("chunk")))
    # One row per byte string: its first place and how often it occurs.
    texts = every_chunk.groupBy("h", "chunk").agg(F.min(F.struct(KEY, "pos")).alias("first"), F.count("*").alias("n"))
    firsts = materialize(texts.select("h", "first", "n"), "chunk-firsts")
    per_hash = firsts.groupBy("h").agg(F.count("*").alias("kinds"), F.min("first").alias("first"), F.sum("n").alias("n"))
    per_hash = materialize(per_hash.where("n > 1"), "chunk-hashes")
    proven = per_hash.where("kinds = 1").select("h", "first")
    known = every_chunk.select(KEY, "pos", "h").join(proven, "h").where(
        F.struct(KEY, "pos") != F.col("first")).select(KEY, "pos")
    clashes = per_hash.where("kinds > 1").select("h")
    if clashes.isEmpty():
        return known
    doubtful = every_chunk.join(clashes, "h")
    clash = doubtful.groupBy("h", "chunk").agg(F.min(F.struct(KEY, "pos")).alias("first"))
    told = doubtful.join(clash, ["h", "chunk"]).where(F.struct(KEY, "pos") != F.col("first")).select(KEY, "pos")
    return known.unionByName(told)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW,
                every: int = EVERY, min_lines: int = MIN_LINES, max_lines: int = MAX_LINES) -> DataFrame:
    """`docs` with repeated chunks taken out of `text`, and `n_lines`, `n_removed` (lines).

    Kept lines stay in order, joined by line feeds; a document left without lines has an empty
    text.  Null texts stay null with 0 lines.  Rows equal in id and text count as one document and
    get one result, each; null ids are a value like others.  Columns named `n_lines` or `n_removed`
    are replaced.  An empty table stays empty.
    """
    gone = repeated_chunks(docs, id_col, text, window, every, min_lines, max_lines)
    gone = gone.groupBy(KEY).agg(F.sort_array(F.collect_set("pos")).alias("gone")).withColumnRenamed(KEY, "k")
    rows = keyed(docs, id_col, text).join(gone, F.col(KEY) == F.col("k"), "left").drop("k", KEY)
    source = F.col(f"{ROW}.{text}")
    cut = chunk_lines(F.split(source, "\n", -1), window, every, min_lines, max_lines)

    def between(all_):
        """The runs of chunks between those that go."""
        def run(g, j):
            before = F.coalesce(F.get("gone", j - 1), F.lit(-1))
            return F.slice(all_, before + 2, g - before - 1)
        return F.struct(F.flatten(F.flatten(F.transform(F.concat("gone", F.array(F.size(all_))), run))).alias("kept"))

    chunks = _let(cut, between)
    rows = rows.select(ROW, "gone", F.when(F.col("gone").isNotNull(), chunks).alias("out"))
    n = F.coalesce(F.size(F.split(source, "\n", -1)), F.lit(0))
    n = F.when(source.isNull(), 0).otherwise(n)
    new = F.when(F.col("gone").isNull(), source).otherwise(F.array_join("out.kept", "\n"))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    cols = [new.alias(c) if c == text else F.col(f"{ROW}.`{c}`").alias(c) for c in kept]
    return rows.select(*cols, n.cast("long").alias("n_lines"),
                       F.when(F.col("gone").isNull(), F.lit(0)).otherwise(n - F.size("out.kept")).cast("long").alias("n_removed"))
