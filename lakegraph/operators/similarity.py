"""Which names are nearly the same: a similarity join by pieces that loses no pair.

The ratio of two names is twice the length of their matching blocks over the sum of their lengths. Matching blocks are a
common subsequence, so that at a ratio of r percent or more one name becomes the other by at most
``t = (100 - r) * (sum of lengths) / 100`` insertions and deletions. Each of them breaks at most one of the longer name's
disjoint pieces: of any ``t + 1`` pieces one stands whole in the shorter name, moved by at most what the other edits
allow. The rarest pieces are taken, pairs that meet by one are held against the places and lengths, then against the
edit distance (which is no greater than ``t`` either), all inside the join. Only what is left needs letter by letter
comparison.

Names that are mostly alike, such as numbered ones, meet by their pieces nearly all. Such a pair also has
``(sum of lengths - t) / 2`` letters or more in common, in order: what is left of both when so many letters are kept is
another key, by which no other pairs meet. Which of the two it is, is counted beforehand for the names of each place and
two lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakegraph.sources.sinks import stored as written

#: Letters of a name from which on a pair is compared once for all its pieces.
LONG = 48


def edits(total: Column, least: int) -> Column:
    """Insertions and deletions that names of ``total`` letters in all may need at a ratio of ``least`` percent."""
    return F.floor(total * (100 - least) / 100).cast("int")


def piece_size(n: Column, least: int) -> Column:
    """Letters of a piece of a name of ``n`` letters, so that there is one more piece than edits to any name that isn't longer."""
    return F.greatest(F.lit(1), F.floor(n / (edits(2 * n, least) + 1))).cast("int")


#: A name has as many keys of letters that are left at most; they are one array.
MOST_KEYS = 20_000


def _named(df: DataFrame, name: str) -> DataFrame:
    """``key, place, name, n``: the distinct names of each place, numbered; equal names stand for all their rows."""
    names = df.where("place is not null and length(name) > 0").select("place", "name").distinct()
    return written(names.select(F.monotonically_increasing_id().alias("key"), "place", "name", F.length("name").alias("n")), name)


def _pieces(names: DataFrame, least: int) -> DataFrame:
    """``key, place, name, n, size, at, piece``: disjoint pieces of each name, all of its piece size."""
    known = names.withColumn("size", piece_size(F.col("n"), least))
    starts = F.sequence(F.lit(0), F.floor(F.col("n") / F.col("size")).cast("int") - 1)
    cut = F.transform(starts, lambda k: F.struct((k * F.col("size")).alias("at"), F.substring(F.col("name"), k * F.col("size") + 1, F.col("size")).alias("piece")))
    return known.select("key", "place", "name", "n", "size", F.inline(cut))


def _grams(names: DataFrame, least: int) -> DataFrame:
    """``key, place, name, n, at, piece``: all parts of a name that a longer or equal name's pieces may be like."""
    most = F.floor(F.col("n") * (100 + (100 - least)) / (100 - (100 - least))).cast("int")
    sizes = F.array_distinct(F.transform(F.sequence(F.col("n"), most), lambda n: piece_size(n, least)))
    sizes = F.filter(sizes, lambda s: s <= F.col("n"))
    parts = F.flatten(F.transform(sizes, lambda s: F.transform(F.sequence(F.lit(0), F.col("n") - s), lambda k: F.struct(k.alias("at"), F.substring(F.col("name"), k + 1, s).alias("piece")))))
    return names.select("key", "place", "name", "n", F.inline(parts))


def _choices(n: Column, k: Column) -> Column:
    """How many ways there are to take ``k`` of ``n`` letters away."""
    ways = F.aggregate(F.sequence(F.lit(1), k), F.lit(1.0), lambda c, i: c * (n - k + i) / i)
    return F.when(k <= 0, 1.0).otherwise(ways)


def _shortened(name: Column, k: Column) -> Column:
    """The distinct texts that are left of ``name`` without ``k`` letters; they are taken away from the left to the right."""

    def without_one(s: Column) -> Column:
        n, text = F.length(s["text"]), s["text"]
        places = F.when(s["at"] <= n, F.sequence(s["at"], n)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, n)).alias("text"), i.alias("at")))

    whole = F.array(F.struct(name.alias("text"), F.lit(1).alias("at")))
    fewer = F.aggregate(F.sequence(F.lit(1), k), whole, lambda texts, _: F.flatten(F.transform(texts, without_one)))
    return F.when(k <= 0, F.array(name)).otherwise(F.array_distinct(fewer["text"]))


def _lengths(longer: DataFrame, shorter: DataFrame, least: int, strict: bool) -> DataFrame:
    """``place, n, m, common, most, keys``: lengths at a place that may be near, the letters such names have in common, the keys by these for a name at most and in all."""
    a = longer.groupBy("place", "n").agg(F.count("*").alias("_a"))
    b = shorter.groupBy("place", F.col("n").alias("m")).agg(F.count("*").alias("_b"))
    n, m, t = F.col("n"), F.col("m"), edits(F.col("n") + F.col("m"), least)
    pairs = a.join(b, "place").where(((m < n) if strict else (m <= n)) & (n - m <= t)).withColumn("common", F.ceil((n + m - t) / 2).cast("int"))
    of_n, of_m = _choices(n, n - F.col("common")), _choices(m, m - F.col("common"))
    return pairs.select("place", "n", "m", "common", F.greatest(of_n, of_m).alias("most"), (F.col("_a") * of_n + F.col("_b") * of_m).alias("keys"))


def _by_letters(longer: DataFrame, shorter: DataFrame, lengths: DataFrame) -> DataFrame:
    """``long_key, short_key`` of the names that have ``common`` letters in common, in order."""
    # small tables, but many keys of each name: dealt out to all cores
    spark = longer.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def keyed(names: DataFrame, own: str, out: str) -> DataFrame:
        rows = names.join(lengths, ["place", own]).repartition(tasks, "key")
        texts = _shortened(F.col("name"), F.col(own) - F.col("common"))
        return rows.select(F.col("key").alias(out), "place", "n", "m", F.explode(texts).alias("_text")).select(out, F.xxhash64("place", "n", "m", "_text").alias("_letters"))

    return keyed(longer, "n", "long_key").join(keyed(shorter.withColumnRenamed("n", "m"), "m", "short_key"), "_letters").select("long_key", "short_key")


def _half(longer: DataFrame, shorter: DataFrame, least: int, strict: bool) -> DataFrame:
    """``long_key, short_key`` of the pairs whose first name is longer (or as long, unless ``strict``) and near the second."""
    lengths = written(_lengths(longer, shorter, least, strict), "lengths")
    longer = longer.join(lengths, ["place", "n"], "left_semi")
    shorter = shorter.join(lengths.select("place", F.col("m").alias("n")), ["place", "n"], "left_semi")
    grams = _grams(shorter, least)
    many = grams.groupBy("piece").agg(F.count("*").alias("many"))
    rarest = Window.partitionBy("key").orderBy(F.coalesce("many", F.lit(0)), "at")
    pieces = _pieces(longer, least).join(many, "piece", "left").withColumn("rank", F.row_number().over(rarest))
    pieces = pieces.where((F.col("rank") <= edits(2 * F.col("n"), least) + 1) & F.col("many").isNotNull()).drop("many", "size")
    counted = pieces.groupBy("place", "n", "piece").agg(F.count("*").cast("double").alias("_a")).join(grams.groupBy("place", F.col("n").alias("m"), "piece").agg(F.count("*").cast("double").alias("_b")), ["place", "piece"])
    meet = counted.groupBy("place", "n", "m").agg(F.sum(F.col("_a") * F.col("_b")).alias("_meet"))
    lengths = written(lengths.join(meet, ["place", "n", "m"]).withColumn("letters", (F.col("_meet") > F.col("keys")) & (F.col("most") <= MOST_KEYS)), "meeting")
    letters = _by_letters(longer, shorter, lengths.where("letters").select("place", "n", "m", "common"))
    pieces = pieces.join(lengths.where("not letters").groupBy("place", "n").agg(F.collect_set("m").alias("lengths")), ["place", "n"]).alias("l")
    grams = grams.join(lengths.where("not letters").select("place", F.col("m").alias("n")), ["place", "n"], "left_semi").alias("s")
    t = edits(F.col("l.n") + F.col("s.n"), least)
    moved, shorter_by = F.col("s.at") - F.col("l.at"), F.col("s.n") - F.col("l.n")
    fits = F.array_contains("l.lengths", F.col("s.n")) & (F.col("l.rank") <= t + 1) & (F.abs(moved) + F.abs(shorter_by - moved) <= t)
    same = (F.col("l.piece") == F.col("s.piece")) & (F.col("l.place") == F.col("s.place"))
    near = F.expr(f"levenshtein(l.name, s.name, cast(floor((l.n + s.n) * {100 - least} / 100) as int)) >= 0")
    ids = [F.col("l.key").alias("long_key"), F.col("s.key").alias("short_key")]
    # CASE keeps the dear comparison behind the cheap ones; long names may meet by many pieces, so their pairs are told apart first
    short = pieces.where(F.col("n") <= LONG).join(grams, same & F.when(fits, near).otherwise(False)).select(*ids)
    long = pieces.where(F.col("n") > LONG).join(grams, same & fits).select(*ids, F.struct(F.col("l.name"), F.col("l.n")).alias("l"), F.struct(F.col("s.name"), F.col("s.n")).alias("s"))
    long = long.groupBy("long_key", "short_key").agg(F.first("l").alias("l"), F.first("s").alias("s")).where(near)
    return short.unionByName(long.select("long_key", "short_key")).unionByName(letters)


def near_names(left: DataFrame, right: DataFrame, least: int = 88, by_place: bool = False) -> DataFrame:
    """``left_id, right_id`` (and ``place``, with ``by_place``): all pairs of one place whose names may have a ratio of ``least`` percent or more, each once.

    Both sides have ``id, place, name``; an ``id`` may stand at several places, once at each. Every pair at the ratio is
    among the result; a few others are too, whose edit distance is as small, but whose letters match in fewer blocks. Null
    and empty names are near nothing, nor are rows without place. Rows of a frequent piece are compared inside its join,
    which Spark splits where it is skewed; where more would meet so than the names have keys of common letters, these are
    the keys.
    """
    a, b = _named(left, "left-names"), _named(right, "right-names")
    down = _half(a, b, least, strict=False).select(F.col("long_key").alias("_l"), F.col("short_key").alias("_r"))
    up = _half(b, a, least, strict=True).select(F.col("short_key").alias("_l"), F.col("long_key").alias("_r"))
    near = down.unionByName(up).distinct()
    near = near.join(a.select(F.col("key").alias("_l"), "place", F.col("name").alias("_left")), "_l").join(b.select(F.col("key").alias("_r"), F.col("name").alias("_right")), "_r").drop("_l", "_r")
    near = near.join(left.select(F.col("id").alias("left_id"), "place", F.col("name").alias("_left")), ["place", "_left"]).join(right.select(F.col("id").alias("right_id"), "place", F.col("name").alias("_right")), ["place", "_right"])
    return near.select("left_id", "right_id", *(["place"] if by_place else [])).distinct()
