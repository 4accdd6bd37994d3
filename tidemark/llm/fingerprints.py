"""Document fingerprints by SimHash, in DataFrame functions only.

Terms are pairs of neighbouring words of the lower-cased text (the word alone, if there is one), repeats included,
hashed by XXH64. Each occurrence votes on the 64 bits with a weight that grows with the term's length, so that pairs of
short function words count less. A text and its edited text share their beginning, so the terms of both are exploded
once, in three parts (shared, own, edited), and summed again in the same task: 32 sums, each with the votes on two bits
in its halves, so that only one slim row for each text is shuffled. A text is shorter than 2 ** 31 bytes and so has
fewer than 2 ** 32 votes, and equal rows are counted once, so no half runs over. Fingerprints within ``RADIUS`` bits are
found by permuted block tables: of ``BLOCKS`` blocks, two such fingerprints share at least ``BLOCKS - RADIUS`` whole
blocks, so each choice of that many blocks is the key of one table. A bucket with more than ``CROWDED`` fingerprints is
dealt again by the blocks of the bits that its key leaves open, so none can hold more than about 2 ** 16.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import copied, durable, written

RADIUS, BLOCKS = 3, 6
#: Fingerprints from which on a bucket of a block table is dealt again.
CROWDED = 4096
#: Rows of one doc_id from which on they are dealt over several tasks.
HOT_ROWS = 50_000
_SPACE = " \t\n\r\x0b\x0c"
_HALVES = 0x0000000100000001


def words_of(text: Column) -> Column:
    """The words of the lower-cased text; one empty word if it has none."""
    return F.split(F.btrim(F.lower(text), F.lit(_SPACE)), r"\s+")


def terms(words: Column, alone: Column) -> Column:
    """Neighbouring words as structs of two; a word without a neighbour, second part null, if ``alone`` holds; none without words."""
    pairs = F.arrays_zip(F.slice(words, F.lit(1), F.size(words) - 1).alias("a"), F.slice(words, F.lit(2), F.size(words)).alias("b"))
    single = F.array(F.struct(words[0].alias("a"), F.lit(None).cast("string").alias("b")))
    none = F.array().cast("array<struct<a:string,b:string>>")
    return F.when(F.size(words) > 1, pairs.cast("array<struct<a:string,b:string>>")).when(alone & (words[0] != ""), single).otherwise(none)


def _votes(texts: DataFrame, by: list[str], kept: list[str]) -> DataFrame:
    """``by``, the greatest of each number in ``kept``, and the sums n, c0 to c31 of the votes of the terms in ``term``."""
    length = F.length("term.a") + F.coalesce(F.length("term.b") + 1, F.lit(0))
    weight = F.when(F.col("term.a").isNull(), 0).when(length <= 7, 1).when(length <= 12, 2).otherwise(3)
    votes = texts.select(*by, *kept, F.xxhash64("term.a", "term.b").alias("h"), weight.cast("long").alias("w"))
    sums = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(_HALVES)) * F.col("w")).alias(f"c{i}") for i in range(32)]
    return votes.groupBy(*by).agg(*[F.max(c).alias(c) for c in kept], F.sum("w").alias("n"), *sums)


def _bits(n: Column, sums: list[Column]) -> Column:
    """A bit is set if more than half of the votes have it set; without votes all are zero."""
    count = lambda bit: F.shiftrightunsigned(sums[bit % 32], 32 * (bit // 32)).bitwiseAND(F.lit(0xFFFFFFFF))
    one = lambda bit: F.lit((1 << bit) - (1 << 64 if bit == 63 else 0)).cast("long")
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(count(bit) * 2 > n, one(bit)).otherwise(F.lit(0).cast("long")) for bit in range(64)])


def fingerprints(texts: DataFrame, by: list[str], column: str = "text") -> DataFrame:
    """The columns ``by``, which tell rows apart, and ``bits``, the fingerprint of ``column`` as a signed 64-bit number."""
    words = words_of(F.col(column))
    counted = _votes(texts.select(*by, F.explode_outer(terms(words, F.lit(True))).alias("term")), by, [])
    return counted.select(*by, _bits(F.col("n"), [F.col(f"c{i}") for i in range(32)]).alias("bits"))


def fingerprint_pairs(rows: DataFrame, by: list[str], kept: list[str]) -> DataFrame:
    """``by``, ``kept`` (numbers), bits and edited_bits: fingerprints of ``text`` and of its edited text.

    The edited text is ``text`` up to the code point ``cut``, then ``start``. What both have in common is exploded once:
    all words that end before the cut.
    """
    shared = F.substring("text", F.lit(1), F.col("cut"))
    head = F.regexp_extract(shared, r"(?s)^(.*\s)", 1)
    parted = rows.select(
        *by, *kept, words_of(head).alias("head"), F.substr(F.col("text"), F.length(head) + 1).alias("own"),
        F.concat(F.substr(shared, F.length(head) + 1), F.col("start")).alias("edited"),
    )
    # The last shared word starts the other two parts, so that no pair is lost where they meet.
    last, lone = F.element_at("head", -1), (F.size("head") == 1)
    joined = lambda c: words_of(F.concat(last, F.lit(" "), F.col(c)))
    parts = F.array(
        F.struct(F.lit(0).alias("part"), terms(F.col("head"), F.lit(False)).alias("terms")), F.struct(F.lit(1).alias("part"), terms(joined("own"), lone).alias("terms")),
        F.struct(F.lit(2).alias("part"), terms(joined("edited"), lone).alias("terms")),
    )
    listed = parted.select(*by, *kept, F.explode(parts).alias("p")).select(*by, *kept, "p.part", F.explode_outer("p.terms").alias("term"))
    counted = _votes(listed, [*by, "part"], kept)
    names = ["n", *[f"c{i}" for i in range(32)]]
    of = lambda other, c: F.sum(F.when(F.col("part") != other, F.col(c)).otherwise(F.lit(0).cast("long")))
    both = counted.groupBy(*by).agg(*[F.max(c).alias(c) for c in kept], *[of(2, c).alias(f"own_{c}") for c in names], *[of(1, c).alias(f"edited_{c}") for c in names])
    bits = lambda side: _bits(F.col(f"{side}_n"), [F.col(f"{side}_c{i}") for i in range(32)])
    return both.select(*by, *kept, bits("own").alias("bits"), bits("edited").alias("edited_bits"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal bits of two fingerprints, 0 to 1."""
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def hex_digits(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def next_keys(keys: DataFrame) -> DataFrame:
    """For each of the distinct numbers in ``key``, the next smaller one; the largest follows the smallest.

    Numbers meet their successors in windows over ranges of 2 ** 12 numbers; what is left, the ends of ranges, goes on to
    ranges of 2 ** 16 ranges, and so on. However the numbers lie, no window holds more than 2 ** 20 of them.
    """
    level = keys.select("key", F.col("key").alias("low"))  # runs of numbers from key (largest) down to low (smallest)
    found = None
    for shift in (12, 28, 44, 64):
        place = F.shiftright("key", shift) if shift < 64 else F.lit(0)
        w = Window.partitionBy("range").orderBy(F.desc("key"))
        linked = level.withColumn("range", place).withColumn("after", F.lead("key").over(w))
        pairs = linked.filter("after IS NOT NULL").select(F.col("low").alias("key"), F.col("after").alias("next_key"))
        found = pairs if found is None else found.unionByName(pairs)
        level = linked.groupBy("range").agg(F.max("key").alias("key"), F.min("low").alias("low")).select("key", "low")
    return found.unionByName(level.select(F.col("low").alias("key"), F.col("key").alias("next_key")))


def compare_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text, of its edited text and of the next document, and how many others are near.

    ``n_near`` counts the other fingerprints in the table, equal ones once, at most ``RADIUS`` bits away.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many of the next document in
    descending order of doc_id (after the last, the first). A null text is empty. Rows with a null doc_id stand after
    all others. Rows that share a doc_id are compared with the same next document; where the next doc_id is repeated,
    the smallest start of a text stands for it. Rows that are equal give a row each. Texts are read whole, however long;
    a text, its edited text and their terms stand in the memory of one task. An empty table gives no row; other columns
    are left out.
    """
    least = -(1 << 63)
    key, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(least)), F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("salt", F.xxhash64("text"))
    slim = written(base.groupBy("key").agg((F.max(F.length("text")) / 3).cast("long").alias("most"), F.count(F.lit(1)).alias("rows")))
    # Few doc_ids are hot: at most one in HOT_ROWS rows. Written down, so that Spark knows the size and may broadcast it.
    hot = written(slim.filter(F.col("rows") > HOT_ROWS).select("key", F.ceil(F.col("rows") / HOT_ROWS).alias("tasks")))
    dealt = (
        base.join(hot, "key", "left").withColumn("r", F.coalesce(F.pmod(F.xxhash64("salt", F.spark_partition_id()), F.col("tasks")), F.lit(0).cast("long")))
        .select("key", "r", "salt", "doc_id", "text").repartition("key", "r")
    )
    over_tasks = lambda df: df.join(hot, "key", "left").withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("tasks") - 1, F.lit(0).cast("long"))))).drop("tasks")
    wanted = over_tasks(slim.select("key", "most").join(next_keys(slim.select("key")), "key").select(F.col("key").alias("asker"), "most", F.col("next_key").alias("key")))
    # Both joins ask for the same columns of the documents, so that one exchange of the texts serves them.
    start = F.struct(F.substring("text", F.lit(1), F.col("most").cast("int")).alias("start"), "salt", "key", "doc_id")
    pieces = over_tasks(dealt.join(wanted, ["key", "r"]).groupBy("asker").agg(F.min(start).alias("next")).select(F.col("asker").alias("key"), "next"))
    texts = dealt.groupBy("key", "r", "salt").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("cut")), F.col("start"))
    sha = [F.conv(F.substring(F.sha2(edited, 256), 16 * i + 1, 16), 16, -10).cast("long").alias(f"sha{i}") for i in range(4)]
    changed = (
        texts.join(pieces, ["key", "r"])
        .select("key", "r", "salt", "doc_id", n.cast("long").alias("n_chars"), F.col("next.key").alias("next_key"), F.col("next.salt").alias("next_salt"), "text", (n - third).alias("cut"), F.substring("next.start", F.lit(1), third).alias("start"))
        .select("*", *sha)
    )
    kept = ["doc_id", "n_chars", "next_key", "next_salt", "sha0", "sha1", "sha2", "sha3"]
    found = fingerprint_pairs(changed, ["key", "r", "salt"], kept).drop("r").dropDuplicates(["key", "salt"])
    copies = base.groupBy("key", "salt").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    found = durable(found.join(copies, ["key", "salt"], "left"))
    # Written down, so that the join below has plain exchanges on both sides, which Spark can split at the fingerprint of many copies.
    near = durable(near_fingerprints(found).select(F.explode(F.array("a", "b")).alias("bits")).groupBy("bits").agg(F.count(F.lit(1)).alias("n_near")))
    after = found.select(F.col("key").alias("next_key"), F.col("salt").alias("next_salt"), F.col("bits").alias("next_bits"))
    return (
        copied(found.join(after, ["next_key", "next_salt"]).join(near, "bits", "left"), "copies")
        .select(
            "doc_id", "n_chars", F.concat(*[hex_digits(F.col(f"sha{i}")) for i in range(4)]).alias("edited_sha256"), hex_digits(F.col("bits")).alias("fingerprint"),
            hex_digits(F.col("edited_bits")).alias("edited_fingerprint"), likeness(F.col("bits"), F.col("edited_bits")).alias("near_edited"),
            likeness(F.col("bits"), F.col("next_bits")).alias("near_next"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        )
    )


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def block_masks(bits: list[int]) -> list[int]:
    """A mask for each choice of ``BLOCKS - RADIUS`` of the blocks that ``bits`` are cut into, in order."""
    edges = [round(len(bits) * i / BLOCKS) for i in range(BLOCKS + 1)]
    block = [sum(1 << b for b in bits[edges[i] : edges[i + 1]]) for i in range(BLOCKS)]
    return [sum(block[i] for i in chosen) for chosen in combinations(range(BLOCKS), BLOCKS - RADIUS)]


def near_fingerprints(fingerprints: DataFrame, column: str = "bits") -> DataFrame:
    """All pairs (a, b), a < b, of distinct fingerprints at most ``RADIUS`` bits apart, each once.

    Every table is keyed by one choice of ``BLOCKS - RADIUS`` whole blocks; the fingerprints of a crowded bucket are
    dealt again into tables over the bits that its key leaves open. A pair counts in the first table that it meets in,
    so nothing is sorted out afterwards. Nulls are ignored; equal fingerprints count once.
    """
    distinct = fingerprints.select(F.col(column).cast("long").alias("bits")).na.drop().distinct()
    tables = block_masks(list(range(64)))
    inner = [block_masks([b for b in range(64) if not m >> b & 1]) for m in tables]
    at = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("bits").bitwiseAND(F.lit(_signed(m))).alias("block_key")) for t, m in enumerate(tables)])).alias("at")
    dealt = distinct.select("bits", at).select("bits", "at.t", "at.block_key")
    crowded = written(dealt.groupBy("t", "block_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWDED).select("t", "block_key", F.lit(True).alias("crowded")))
    # For each second table, its mask under every first table.
    seconds = [F.element_at(F.array(*[F.lit(_signed(own[u])) for own in inner]), F.col("t") + 1) for u in range(len(tables))]
    again = F.when(F.col("crowded"), F.array(*[F.struct(F.lit(u).alias("u"), F.col("bits").bitwiseAND(m).alias("within")) for u, m in enumerate(seconds)]))
    once = F.array(F.struct(F.lit(-1).alias("u"), F.lit(0).cast("long").alias("within")))
    placed = dealt.join(crowded, ["t", "block_key"], "left").select("bits", "t", "block_key", F.explode(F.coalesce(again, once)).alias("again")).select("bits", "t", "block_key", "again.u", "again.within")
    a, b = placed.toDF("a", "t", "block_key", "u", "within"), placed.toDF("b", "t", "block_key", "u", "within")
    apart = F.col("a").bitwiseXOR(F.col("b"))
    first = lambda columns, name: reduce(lambda c, x: c.when(apart.bitwiseAND(x[1]) == 0, F.lit(x[0])), enumerate(columns), F.when(F.lit(False), F.lit(-1))) == F.col(name)
    met = a.join(b, ["t", "block_key", "u", "within"]).filter((F.col("a") < F.col("b")) & (F.bit_count(apart) <= RADIUS) & first([F.lit(_signed(m)) for m in tables], "t"))
    return met.filter((F.col("u") < 0) | first(seconds, "u")).select("a", "b")
