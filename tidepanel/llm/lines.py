"""Line dedup, with DataFrame functions only: fuzzy lines by MinHash, keeping one line per component.

A line is the set of its character shingles. Its MinHashes are the shingle hashes nearest to fixed points, nearest by
exclusive or: for each point, two lines agree with the probability of their Jaccard similarity. The values of a few points
make a band's key, and lines that share a key are candidates.

Every line is first compared with the smallest line of each of its keys, its head: one pair for each line and key, whatever
the group's size. A distributed union-find ties what is alike. Lines with the same head that lie in different components
are then joined by what sets them apart from the text that most of them hold, so that copies edited in their own ways, and
lines that quote one passage, meet nowhere and a family's pairs are never listed. No pair is lost: two lines at or over the
threshold either share a good part of what sets them apart, and then meet by prefix filtering, or are both so near that
text that they are alike to the nearest line as well. Small groups, nearly all, need no such text: they list their pairs. Parity bits,
by which two lines differ in no more places than by shingles, drop most pairs that can't be alike. Pairs are verified by the exact
Jaccard similarity of the two shingle sets, and each final component keeps its first line.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.8
    shingle: int = 8
    #: Keys of a line, and MinHashes in a key: at the threshold a pair shares a key with probability 1 - (1 - 0.8 ** 3) ** 7 = 0.993.
    bands: int = 7
    per_band: int = 3
    #: Lines that meet one copy of their head; the head of a larger group is copied.
    block: int = 1000
    #: Lines of a head that its usual shingles are read off, and up to how many lines a head's own shingles do; results don't hang on these.
    read: int = 24
    small: int = 4
    #: Lines of a head up to which all its pairs are looked at; lines of larger ones meet by their prefixes. Results don't hang on it.
    few: int = 32
    #: Longs of 64 bits that tell most pairs that differ in too many shingles before they are verified. Results don't hang on it.
    words: int = 8


def long(x: int) -> Column:
    """A 64-bit pattern as a signed long."""
    return F.lit(x - 2**64 if x >= 2**63 else x)


def shingles(line: Column, s: Settings) -> Column:
    """The hashes of a line's character shingles; a line shorter than a shingle is one shingle."""
    # two bytes a character, so a shingle is cut in constant time
    return F.transform(F.array(F.encode(line, "UTF-16BE")), lambda d: F.transform(F.sequence(F.lit(1), last_start(d, s), F.lit(2)), lambda i: F.xxhash64(F.substring(d, i, F.lit(2 * s.shingle)))))[0]


def last_start(data: Column, s: Settings) -> Column:
    """Where the last shingle of a line in UTF-16 begins, from 1."""
    return F.greatest(F.length(data) - 2 * s.shingle + 1, F.lit(1))


def signatures(lines: DataFrame, s: Settings, step: int = 4) -> DataFrame:
    """(lid, keys) of lines (lid, line), one row for each lid: a band's key packs the low bits of its MinHashes.

    Every `step` characters are a row with as many hashes, so that the aggregation has few rows; lines bucketed by lid
    are signed without a shuffle.
    """
    points, bits = s.bands * s.per_band, 63 // s.per_band
    data = lines.select("lid", F.encode("line", "UTF-16BE").alias("data"))
    at = data.select("lid", "data", last_start(F.col("data"), s).alias("last"), F.explode(F.sequence(F.lit(1), last_start(F.col("data"), s), F.lit(2 * step))).alias("at"))
    # the last row of a line repeats its last shingle, which doesn't change a set
    some = at.select("lid", *(F.xxhash64(F.substring("data", F.least(F.col("at") + 2 * k, F.col("last")), F.lit(2 * s.shingle))).alias(f"h{k}") for k in range(step)))
    # least of two at a time, over few hashes: code that a JVM compiles well
    near = (reduce(F.least, (F.col(f"h{k}").bitwiseXOR(long((p * 2**64 // points) ^ 2**63)) for k in range(step))) for p in range(points))
    least = some.groupBy("lid").agg(*(F.min(x).alias(f"m{p}") for p, x in enumerate(near)))
    lane = lambda p, k: F.shiftleft(F.col(f"m{p}").bitwiseAND(F.lit(2**bits - 1)), bits * k)
    keys = (reduce(lambda a, b: a.bitwiseOR(b), (lane(b + k * s.bands, k) for k in range(s.per_band))) for b in range(s.bands))
    return least.select("lid", F.array(*keys).alias("keys"))


def split_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, pos, line) of every line that isn't blank, white space at its ends cut off."""
    lines = docs.select("row", F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("pos", "line"))
    return lines.select("row", "pos", F.btrim("line").alias("line")).where("line <> ''")


def with_heads(signed: DataFrame, s: Settings) -> DataFrame:
    """(head, lid): each line with the head of each of its keys, other than itself.

    A key's head is the line whose keys hold the most lines in all, as the text that a family was copied from does.
    """
    # the lines of a key are counted and joined after one and the same shuffle: both read key and lid
    keyed = signed.select("lid", F.posexplode("keys").alias("band", "value")).select("lid", F.xxhash64("band", "value").alias("key")).repartition("key")
    several = keyed.groupBy("key").agg(F.count("lid").alias("n")).where("n > 1")
    # few keys have several lines; a table of them meets all the others unsorted
    members = shared.stored(keyed.join(several.hint("shuffle_hash"), "key").select("key", "lid", "n"))
    known = members.groupBy("lid").agg(F.sum("n").alias("known"))
    ranked = shared.stored(members.join(known, "lid").select("key", "lid", "n", F.struct("known", (-F.col("lid")).alias("least")).alias("rank")))
    heads = shared.stored(ranked.groupBy("key").agg((-F.max("rank")["least"]).alias("head"), F.count("*").alias("n")))
    return shared.spread_join(ranked.select("key", "lid"), heads, "key", "n", ["lid"]).where("head <> lid").select("head", "lid").distinct()


def head_sets(pairs: DataFrame, heads: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """pairs (head, lid) plus x and r: the shingles of the line, and heads' `usual` ones or else the head's own, each once.

    heads (head, members, usual) is copied for every s.block members, so a head of many lines is many tasks.
    """
    parts = F.ceil(F.col("members") / F.lit(s.block)).cast("int")
    mine = shared.spread_join(pairs, heads.select("head", "members", parts.alias("parts")), "head", "members", ["lid"])
    mine = mine.join(texts, "lid").withColumn("part", F.pmod(F.xxhash64("lid"), F.col("parts")).cast("int"))
    other = heads.join(texts.withColumnsRenamed({"lid": "head", "line": "head_line"}), "head")
    # texts are shuffled, not their shingles, which take eight times the room
    other = other.select("head", "usual", "head_line", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")).repartition("head", "part")
    other = other.select("head", "part", F.coalesce("usual", F.array_distinct(shingles(F.col("head_line"), s))).alias("r"))
    return mine.join(other, ["head", "part"]).select(*pairs.columns, F.array_distinct(shingles(F.col("line"), s)).alias("x"), "r")


def are_alike(x: str, y: str, s: Settings) -> Column:
    """Whether two sets of shingles, columns that hold each once, are alike; sets of too unlike sizes aren't compared."""
    t, n, m = s.threshold, F.size(x), F.size(y)
    return (F.least(n, m) >= t * F.greatest(n, m) - 1e-9) & ((1 + t) * F.size(F.array_intersect(x, y)) >= t * (n + m) - 1e-9)


def against_heads(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """pairs (head, lid) plus alike: whether the line and its head are."""
    heads = shared.stored(pairs.groupBy("head").agg(F.count("*").alias("members")).withColumn("usual", F.lit(None).cast("array<bigint>")))
    return shared.stored(head_sets(pairs, heads, texts, s).select("head", "lid", are_alike("x", "r", s).alias("alike")))


def references(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """(head, members, usual): the shingles that most of a head's lines hold, as read off s.read of them; null for few lines.

    Those that the most hold come first, so few lack them, then in about the order of the text.
    """
    sized = shared.stored(pairs.groupBy("head").agg(F.count("*").alias("members")))
    place = F.row_number().over(Window.partitionBy("head").orderBy(F.xxhash64("lid"), "lid"))
    some = pairs.select("head", "lid", place.alias("place")).where(F.col("place") <= s.read).join(sized.where(F.col("members") > s.small), "head").join(texts, "lid").repartition("head")
    held = some.select("head", "members", F.posexplode(F.array_distinct(shingles(F.col("line"), s))).alias("at", "shingle")).groupBy("head", "members", "shingle").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    usual = held.where(2 * F.col("n") > F.least(F.col("members"), F.lit(s.read))).groupBy("head").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("held"), "at", "shingle")))["shingle"].alias("usual"))
    return shared.stored(sized.join(usual, "head", "left").select("head", "members", "usual"))


def parities(sets: DataFrame, keys: list[str], words: int) -> DataFrame:
    """keys, size and bits of sets (*keys, shingle): a bit is whether the number of the set's shingles that fall on it is odd.

    So two sets differ in at least as many shingles as bits.
    """
    bit, word = F.expr("shiftleft(1L, cast(shingle & 63 as int))"), F.pmod(F.shiftright("shingle", 6), F.lit(words))
    each = (F.bit_xor(F.when(word == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(words))
    found = sets.groupBy(*keys).agg(F.count("*").cast("int").alias("size"), *each)
    return found.select(*keys, "size", F.struct(*(f"w{w}" for w in range(words))).alias("bits"))


def sketched(rows: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """rows (with lid) plus n and bits: the number and the parities of the line's shingles, worked out once for each lid."""
    # texts are bucketed by lid, so neither they nor their shingles are shuffled
    mine = texts.join(rows.select("lid").distinct(), "lid", "left_semi")
    sets = mine.select("lid", F.explode(F.array_distinct(shingles(F.col("line"), s))).alias("shingle"))
    return shared.stored(rows.join(parities(sets, ["lid"], s.words).withColumnRenamed("size", "n"), "lid"))


def apart(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """pairs plus n (shingles of the line), d (those that only one of it and its reference has), o (the line's of these), over, prefix and bits.

    The prefix is the first of d: the line's own, by their hashes, then those it lacks, in the order of the reference. So what one
    edit takes out of a text stands together, and lines meet by the few edits that come first, not by a sample of all. Bits are the
    parities of d; as two lines' d differ in what the lines differ in, so do they.

    With c = (1 - t) / (1 + t), lines x and y are alike just if their d differ in at most c (n_x + n_y) shingles; so if they
    share (over_x + over_y) / 2 of them at least, where over = d - c n, and surely if that is 0 or less. A line that
    shares k of them has d >= k and, with a reference of m shingles, n <= m + d; so k >= (d - c (n + m)) / (1 + c).
    """
    c = (1 - s.threshold) / (1 + s.threshold)
    sets = head_sets(pairs, references(pairs, texts, s), texts, s)
    sets = sets.select(*pairs.columns, F.array_except("x", "r").alias("own"), F.array_except("r", "x").alias("lacked"), F.size("r").alias("m"))
    sets = sets.withColumns({"n": F.size("own") + F.col("m") - F.size("lacked"), "o": F.size("own"), "d": F.size("own") + F.size("lacked")})
    least = F.ceil((F.col("d") - c * (F.col("n") + F.col("m"))) / (1 + c) - 1e-6).cast("int")
    long_prefix = F.col("d") + 1 - F.greatest(least, F.lit(1))
    sets = shared.stored(sets.select(*pairs.columns, "n", "d", "o", (F.col("d") - c * F.col("n")).alias("over"), long_prefix.alias("first"), F.concat(F.sort_array("own"), F.col("lacked")).alias("apart")))
    bits = parities(sets.select("head", "lid", F.explode("apart").alias("shingle")), ["head", "lid"], s.words).drop("size")
    rows = sets.select(*pairs.columns, "n", "d", "o", "over", F.slice("apart", F.lit(1), F.col("first")).alias("prefix")).join(bits, ["head", "lid"], "left")
    none = F.struct(*(F.lit(0).cast("long").alias(f"w{w}") for w in range(s.words)))
    return shared.stored(rows.withColumn("bits", F.coalesce("bits", none)))


def near(s: Settings) -> Column:
    """Whether lines x and y of one head, of n shingles and with bits, are of different classes and may be alike by these."""
    sizes = F.least("n_x", "n_y") >= F.lit(s.threshold) * F.greatest("n_x", "n_y") - 1e-9
    differ = reduce(lambda a, b: a + b, (F.bit_count(F.col(f"bits_x.w{w}").bitwiseXOR(F.col(f"bits_y.w{w}"))) for w in range(s.words)))
    few = differ <= (1 - s.threshold) / (1 + s.threshold) * (F.col("n_x") + F.col("n_y")) + 1e-6
    return (F.col("class_x") != F.col("class_y")) & sizes & few


def may_share() -> Column:
    """Whether lines x and y of one head, from apart, may share enough of what sets them apart, if the first common one is at_x and at_y.

    So many can be common at most: of both lines' own ones, and of those that both lack.
    """
    ahead = lambda end, start: F.least(*(F.col(f"{end}_{side}") - F.col(f"{start}_{side}") for side in "xy"))
    common = F.when(F.col("at_x") < F.col("o_x"), ahead("o", "at") + ahead("d", "o")).otherwise(ahead("d", "at"))
    over = F.col("over_x") + F.col("over_y")
    return (common >= over / 2 - 1e-6) & (over > -1e-6)


def sides(rows: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """rows (head, *columns) as x and as y of a join by head."""
    return tuple(rows.select("head", *(F.col(c).alias(f"{c}_{side}") for c in columns)) for side in "xy")


def in_small(rows: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """(lid_x, lid_y): pairs of rows (head, lid, class) with one head, of different classes, that may be alike by size and bits."""
    x, y = sides(sketched(rows, texts, s), "class", "lid", "n", "bits")
    return x.join(y, "head").where((F.col("lid_x") < F.col("lid_y")) & near(s)).select("lid_x", "lid_y")


def in_large(rows: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """(lid_x, lid_y) as in_small, for heads of any number of lines: by prefix and by its places too.

    Lines that surely are alike are also surely alike to the line of their head that is least apart; they are tied to it. Of
    two lines the one that is less apart, x, has to share over_x with the other at least, so its prefix is shorter. A pair is
    found by the first of each run of shingles that both have one after the other, as its first common one is.
    """
    rows = apart(rows, texts, s)
    nearest = shared.stored(rows.groupBy("head").agg(F.min(F.struct("over", "lid", "class")).alias("nearest"), F.count("*").alias("members")))
    tied = shared.spread_join(rows.select("head", "lid", "class", "over"), nearest, "head", "members", ["lid"])
    tied = tied.where((F.col("over") + F.col("nearest.over") <= 1e-6) & (F.col("class") != F.col("nearest.class"))).select(F.col("lid").alias("lid_x"), F.col("nearest.lid").alias("lid_y"))
    large = rows.select("head", "class", "lid", "n", "d", "o", "over", "bits", "prefix", F.posexplode("prefix").alias("at", "shingle")).withColumn("before", F.get("prefix", F.col("at") - 1))
    x, y = sides(large, "class", "lid", "n", "d", "o", "over", "bits", "at", "before", "shingle")
    x = x.where(F.col("d_x") - F.col("at_x") >= F.col("over_x") - 1e-6).withColumnRenamed("shingle_x", "shingle")
    y = y.withColumnRenamed("shingle_y", "shingle")
    order = (F.col("over_x") < F.col("over_y")) | ((F.col("over_x") == F.col("over_y")) & (F.col("lid_x") < F.col("lid_y")))
    starts = F.coalesce(F.col("before_x") != F.col("before_y"), F.lit(True))
    met = x.join(y, ["head", "shingle"]).where(order & starts & may_share() & near(s))
    return met.select("lid_x", "lid_y").unionByName(tied)


def across_classes(compared: DataFrame, classes: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """(a, b): pairs of lines with one head, of different classes, that may be alike; all pairs that are, or what ties them."""
    marked = compared.join(classes, compared.lid == classes.vertex, "left").select("head", "lid", F.coalesce("component", "lid").alias("class"))
    split = marked.groupBy("head").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("members")).where("low <> high")
    rows = shared.stored(marked.join(split.select("head", "members"), "head"))
    small, large = (rows.where(which).select("head", "lid", "class") for which in (F.col("members") <= s.few, F.col("members") > s.few))
    found = in_small(small, texts, s).unionByName(in_large(large, texts, s))
    return found.select(F.least("lid_x", "lid_y").alias("a"), F.greatest("lid_x", "lid_y").alias("b")).distinct()


def verified(pairs: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) of lids whose lines' shingle sets have a Jaccard similarity at or over the threshold."""
    both = pairs.join(texts.withColumnsRenamed({"lid": "a", "line": "x"}), "a").join(texts.withColumnsRenamed({"lid": "b", "line": "y"}), "b")
    both = both.select("a", "b", *(F.array_distinct(shingles(F.col(c), s)).alias(c) for c in "xy"))
    return shared.stored(both.select("a", "b", are_alike("x", "y", s).alias("alike"))).where("alike").select("a", "b")


def line_classes(lines: DataFrame, s: Settings) -> DataFrame:
    """(vertex, component) of the lines (lid, line), one row for each lid, that are alike to another one."""
    pairs = shared.stored(with_heads(signatures(lines, s), s))
    needed = pairs.select(F.explode(F.array("head", "lid")).alias("lid")).distinct()
    texts = shared.stored(lines.select("lid", "line").join(needed, "lid", "left_semi"), by="lid")
    compared = against_heads(pairs, texts, s)
    classes = shared.components(compared.where("alike").select(F.col("head").alias("a"), F.col("lid").alias("b")))
    across = verified(across_classes(compared, classes, texts, s), texts, s)
    known = classes.where("vertex <> component").select(F.col("vertex").alias("a"), F.col("component").alias("b"))
    return shared.components(known.unionByName(across))


def repeated(docs: DataFrame, s: Settings | None = None, text: str = "text") -> DataFrame:
    """(row, gone) for docs with a column row that orders them: the positions of the lines to drop, of rows with any."""
    s = s or Settings()
    lines = split_lines(docs, text).select(F.xxhash64("line").alias("lid"), "row", "pos", "line")
    each = lines.groupBy("lid").agg(F.min("line").alias("line"), F.min(F.struct("row", "pos")).alias("at"), F.count("*").alias("n"))
    each = shared.stored(each, by="lid")
    classes = line_classes(each, s)
    placed = each.select("lid", "at", "n").join(classes, each.lid == classes.vertex, "left").drop("vertex")
    tied = shared.stored(placed.where("component is not null"))
    firsts = shared.stored(tied.groupBy("component").agg(F.min("at").alias("stays"), F.count("*").alias("size")))
    in_classes = shared.spread_join(tied, firsts, "component", "size", ["lid"]).select("lid", "stays", "n")
    alone = placed.where("component is null and n > 1").select("lid", F.col("at").alias("stays"), "n")
    drop = shared.stored(in_classes.unionByName(alone))
    held = shared.spread_join(lines.select("lid", "row", "pos"), drop, "lid", "n", ["row", "pos"])
    gone = held.where((F.col("stays.row") != F.col("row")) | (F.col("stays.pos") != F.col("pos")))
    return shared.stored(gone.groupBy("row").agg(F.collect_set("pos").alias("gone")))


def dedup(docs: DataFrame, s: Settings | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with `text` left with one line of each component, plus n_lines and n_dropped (of lines that aren't blank).

    Lines are alike if their shingle sets have a Jaccard similarity at or over the threshold; equal lines always are. The
    first one, by id, then by position, stays in its place; blank lines stay. A null text stays null with 0 lines; an
    empty one stays empty. Rows with a null id come first; repeated rows are told apart by their text, and rows equal in
    both keep the same lines. Other columns stay as they are, whatever their names. Lines are named by 64-bit hashes.
    """
    s = s or Settings()
    row = F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"))
    kept = docs.drop("n_lines", "n_dropped")
    mine, theirs, gone = shared.free_names(kept.columns, "row", "found_row", "gone")
    found = repeated(kept.select(row.alias("row"), text), s, text).withColumnsRenamed({"row": theirs, "gone": gone})
    # found holds no texts, so a table of it meets them unsorted; it grows with the input, so it isn't broadcast at any size
    out = kept.withColumn(mine, row).join(found.hint("shuffle_hash"), F.col(mine).eqNullSafe(F.col(theirs)), "left")
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    few = F.transform(F.array(F.split(F.col(text), "\n", -1)), lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(gone)), lambda i: F.get(ls, i)), "\n"))[0]
    size = F.coalesce(F.size(gone), F.lit(0))
    shown = F.when(size == 0, F.col(text)).otherwise(few).alias(text)
    n_lines = F.size(F.filter(lines, lambda x: F.btrim(x) != ""))
    return out.select(*(shown if c == text else F.col(f"`{c}`") for c in kept.columns), n_lines.cast("long").alias("n_lines"), size.cast("long").alias("n_dropped"))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with one line of each component left."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def drop_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: lines that stand earlier go; documents that lose all their lines go too."""
    # dedup's counts have names that columns of docs may have too; these step aside
    own = [c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")]
    aside = dict(zip(own, shared.free_names(docs.columns, *(f"{c}_own" for c in own)), strict=True))
    out = dedup(docs.withColumnsRenamed(aside)).where("n_lines > n_dropped or n_lines = 0").drop("n_lines", "n_dropped")
    out = out.withColumnsRenamed({v: k for k, v in aside.items()}).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
