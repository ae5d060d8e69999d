"""Line deduplication by an exact set-similarity join, in DataFrame functions only.

A line is the set of its tokens, the lower-cased runs between spaces. Two lines match at a Jaccard similarity of
THRESHOLD or more, and a line that matches an earlier one is removed. Lines are ordered by document id, then by the hash of the
whole text (for rows that share an id), then by position.

Tokens are put in one global order, rarest first: by how often the token's hash bucket occurs in all of the
documents (RARITY_BITS of the token's hash, a table of fixed size), then by hash. Any order
gives the same matches; a better one only gives fewer pairs to look at. Matching lines share a token of
their prefixes (the first n - ceil(0.8 n) + 1 tokens, and more shared tokens in longer prefixes of long lines), have similar lengths,
leave enough tokens behind the shared position and can't differ in more token classes than in tokens, so only pairs
that pass the prefix, length, positional and parity filters are verified on the token sets of their texts.

Lines of equal sets (the same 64-bit hashes of all tokens, compared by a 128-bit hash) collapse to their first line. In the buckets of tokens that more
than HOT prefixes share, each line is first compared with the earliest line of similar parities; the lines that this removes ask
for no other partner. So a hot group of near copies costs rows in proportion to its size, and no match is lost.

Defined results: lines without a token are kept. Null texts stay null. Rows equal in id and text are one document and keep
the same lines; other rows that share an id (null ids share one, which comes first) are documents of their own. Empty tables stay empty. Other columns pass through.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prospecta.llm.cluster import dropped, written

#: Bits of the buckets of token counts; bits of the map of lines to verify; a shared token more is asked for with every 2^SHARE_BITS tokens.
RARITY_BITS, LINE_BITS, SHARE_BITS = 16, 1 << 20, 7
#: One text in so many is counted by rarity() where its caller doesn't ask for all of them, as removed_lines() does.
SAMPLED = 8
#: Tokens from which on a line has the finer parities; prefixes from which on a token counts as hot, and how many of a line's rarest are looked at
#: for that; the groups that a hot bucket's lines form by parity; a bound of the spans of sizes.
WIDE, HOT, RAREST, SLOTS, SPANS = 96, 128, 4, 16, 32
_NEVER = 1 << 24


def tokens(line: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(line), " ")), "")


def _held(spark: SparkSession, numbers: list[int]) -> Column:
    """An array of many longs as a scalar subquery. A literal would be printed in full in every description of a plan, which the driver keeps."""
    return spark.createDataFrame(pa.table({"numbers": pa.array([numbers], pa.list_(pa.int64()))})).scalar()


def rarity(docs: DataFrame, text_col: str = "text", sampled: int = SAMPLED) -> Column:
    """A constant array: for every hash bucket (the first bits of a token's hash), what turns those bits by exclusive or into its place among all buckets, by how many tokens of the counted texts fall into it: one text in ``sampled``, all with 1."""
    text = F.col(f"`{text_col}`").cast("string")
    counted = docs if sampled == 1 else docs.where(F.pmod(F.xxhash64(text), F.lit(sampled)) == 0)
    words = counted.select(F.explode(F.split(F.replace(F.lower(text), F.lit("\n"), F.lit(" ")), " ")).alias("t"))
    counts = words.groupBy(F.shiftrightunsigned(F.xxhash64("t"), 64 - RARITY_BITS).cast("int").alias("b")).agg(F.count("*").alias("n")).toArrow()
    found = dict(zip(counts.column("b").to_pylist(), counts.column("n").to_pylist(), strict=True))
    table = [0] * (1 << RARITY_BITS)
    for place, b in enumerate(sorted(range(1 << RARITY_BITS), key=lambda b: (found.get(b, 0), b))):
        other = place ^ b ^ (1 << (RARITY_BITS - 1))
        table[b] = (other - (other >> (RARITY_BITS - 1) << RARITY_BITS)) << (64 - RARITY_BITS)
    return _held(docs.sparkSession, table)


def _shared(n: Column) -> Column:
    """How many tokens the prefixes of matching lines share at least: one, and one more for every 2^SHARE_BITS tokens.

    Prefixes of n - ceil(0.8 n) + l tokens share l tokens if the lines match.
    """
    return 1 + F.shiftright(n, SHARE_BITS)


def _doc(id_col: str) -> Column:
    return F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(2**63)))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, h, p, line): a document is its id and the hash of its text."""
    text = F.col(f"`{text_col}`").cast("string")
    # Beside the generator the hash would be worked out once a line.
    whole = docs.select(_doc(id_col).alias("d"), F.xxhash64(text).alias("h"), text.alias("text"))
    return whole.select("d", "h", F.posexplode(F.split("text", "\n")).alias("p", "line"))


def _key() -> Column:
    """A line's number. Two lines that share one by chance are told apart when they are verified."""
    return F.xxhash64("d", "h", "p")


def _sets(docs: DataFrame, id_col: str, text_col: str, table: Column) -> DataFrame:
    """(d, h, p, copy, n, sig, fine, keys): lines by token set; copy: an earlier line has the same set; keys: the prefix.

    sig: the parity of the tokens in each of 64 classes; fine: the same for half of the tokens, on lines of more than WIDE.
    """
    # The first bits of a hash are replaced by their place in the order of rarity: tokens keep all 64 bits of difference.
    order = lambda h: F.coalesce(F.get("places", F.shiftrightunsigned(h, 64 - RARITY_BITS).cast("int")).bitwiseXOR(h), F.lit(0).cast("long"))
    # Hashes first, places of the distinct ones then: a function of an element works out its argument wherever it names it.
    hashes = F.array_distinct(F.transform(F.split(F.lower("line"), " "), lambda t: F.xxhash64(t)))
    keys = F.transform(F.array_remove(hashes, F.xxhash64(F.lit(""))), order)
    # A filter on the keys would be evaluated below them, and so hash all tokens twice.
    lines = _lines(docs, id_col, text_col).where(F.trim("line") != "")
    # The analyzer takes no subquery inside a function of an element; the optimizer puts it there, as the only place that names it.
    lines = lines.select("d", "h", "p", "line", table.alias("places")).select("d", "h", "p", keys.alias("keys"))
    lines = lines.select("d", "h", "p", F.sort_array("keys").alias("keys"))
    shift = lambda value, k: F.call_function("shiftleft", value, k.bitwiseAND(F.lit(63)).cast("int"))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    sig = F.aggregate("keys", zero, lambda a, k: a.bitwiseXOR(shift(one, k)))
    fine = F.aggregate("keys", zero, lambda a, k: a.bitwiseXOR(shift(F.shiftright(k, 6).bitwiseAND(one), k)))
    n = F.size("keys")
    prefix = F.slice("keys", 1, (F.floor(n / 5) + _shared(n)).cast("int"))
    lines = lines.select("d", "h", "p", n.alias("n"), sig.alias("sig"), F.when(n > WIDE, fine).otherwise(zero).alias("fine"), F.xxhash64("keys").alias("s0"), F.xxhash64(F.lit(1), "keys").alias("s1"), prefix.alias("keys"))
    same = Window.partitionBy("s0", "s1").orderBy("d", "h", "p")
    ranked = lines.withColumn("at", F.row_number().over(same)).withColumn("rank", F.rank().over(same)).where("at = 1 or rank > 1")
    first = F.col("rank") == 1
    return ranked.select("d", "h", "p", (~first).alias("copy"), *(F.when(first, F.col(c)).alias(c) for c in ("n", "sig", "fine", "keys")))


_ROW = ("d", "key", "ni", "sig", "fine")


def _prefix_rows(firsts: DataFrame, *more: str) -> DataFrame:
    """(tok, d, key, ni, sig, fine, *more): a row for each prefix token; whether the line is done, its size and the token's index travel as one long."""
    size = F.shiftleft(F.col("n").cast("long"), 31).bitwiseOR(F.shiftleft(F.col("done").cast("long"), 62))
    rows = firsts.select("d", "key", size.alias("size"), "sig", "fine", *more, F.posexplode("keys").alias("i", "tok"))
    return rows.select("tok", "d", "key", F.col("size").bitwiseOR(F.col("i").cast("long")).alias("ni"), "sig", "fine", *more)


def _unpacked(side: str) -> dict[str, Column]:
    ni = F.col(f"{side}.ni")
    part = lambda at, bits: F.shiftright(ni, at).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    return {c: F.col(f"{side}.{c}") for c in ("d", "key", "sig", "fine")} | {"done": part(62, 1), "n": part(31, 31), "i": part(0, 31)}


def _differ(a: dict, b: dict) -> Column:
    """In how many classes the parities of two lines differ: 128 classes where both have the finer ones, else 64."""
    all_ = a["sig"].bitwiseXOR(b["sig"])
    some = a["fine"].bitwiseXOR(b["fine"])
    return F.when(F.least(a["n"], b["n"]) > WIDE, F.bit_count(some) + F.bit_count(all_.bitwiseXOR(some))).otherwise(F.bit_count(all_))


def _fits(a: dict, b: dict) -> Column:
    """Parity, length and positional filters, in whole numbers.

    Matching sets of n and m tokens share ceil(4 (n + m) / 9), so they differ by (n + m) / 9 at most, and so do their parities.
    """
    n, m = a["n"], b["n"]
    alike = lambda differ: 9 * differ <= n + m
    # The k-th shared token has k - 1 before it.
    left = F.least(n - a["i"], m - b["i"]) + _shared(F.least(n, m)) - 1
    return alike(F.bit_count(a["sig"].bitwiseXOR(b["sig"]))) & (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * left >= 4 * (n + m)) & alike(_differ(a, b) + a["done"] * _NEVER)


def _hot(firsts: DataFrame) -> DataFrame:
    """(tok): the tokens that are among the RAREST of more than HOT lines."""
    return firsts.select(F.explode(F.slice("keys", 1, RAREST)).alias("tok")).groupBy("tok").agg(F.count("*").alias("c")).where(F.col("c") > HOT).select("tok")


def _heads(firsts: DataFrame, hot: DataFrame) -> DataFrame:
    """(key, ekey, d, ed): in the hot buckets, each line and the earliest line of its group by parity, if the two pass the filters."""
    rows = _prefix_rows(firsts.withColumns({"done": F.lit(0), "keys": F.slice("keys", 1, RAREST)})).join(hot, "tok", "left_semi")
    slot = Window.partitionBy("tok", F.col("sig").bitwiseAND(F.lit(SLOTS - 1))).orderBy("d", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = rows.select(*_ROW, *(F.first(c).over(slot).alias(f"e{c}") for c in _ROW))
    met = met.select(F.struct(*_ROW).alias("x"), F.struct(*(F.col(f"e{c}").alias(c) for c in _ROW)).alias("e"))
    own, head = _unpacked("x"), _unpacked("e")
    return met.where((own["key"] != head["key"]) & _fits(own, head)).select("x.key", F.col("e.key").alias("ekey"), "x.d", F.col("e.d").alias("ed")).distinct()


def _span(n: Column) -> Column:
    """The power of two that sizes are filed under; any order-preserving function of the size does."""
    return F.floor(F.log2(n)).cast("int")


def _filed(rows: DataFrame) -> DataFrame:
    """Of the rows of tokens and spans, those where a line is found by longer ones: its own span, the first n - ceil(8 n / 9) + l tokens."""
    own = _unpacked("r")
    size = own["n"]
    found = (_span(size) == F.col("r.tok").bitwiseAND(F.lit(SPANS - 1))) & (own["i"] < F.floor(size / 9) + _shared(size))
    # An id of the row, which is never negative, keeps the filter above the exchange that both sides of the join read.
    return rows.alias("r").where(F.when(found, F.monotonically_increasing_id() >= 0).otherwise(F.lit(False)))


def _pairs(firsts: DataFrame, done: DataFrame) -> DataFrame:
    """(key, ekey, d, ed, differ): pairs of lines that meet in as many buckets as matching ones must and pass the filters there.

    Lines of ``done`` (key) are asked for as partners only. Of two lines the one with more tokens looks for the other, in buckets of
    token and span of sizes: the shorter one is found in its own span and under the first n - ceil(8 n / 9) + l tokens only,
    the longer one looks in the one or two spans that 0.8 n to n tokens lie in. Both sides of the join read one exchange.
    """
    marked = firsts.join(done.select("key", F.lit(1).alias("done")), "key", "left").withColumn("done", F.coalesce("done", F.lit(0)))
    low, high = _span(F.ceil(F.col("n") * 4 / 5)), _span(F.col("n"))
    marked = marked.withColumn("span", F.explode(F.when(low == high, F.array(high)).otherwise(F.array(low, high))))
    # The span takes the place of a hash's last bits: tokens that these alone tell apart meet as well, and their lines are verified.
    spanned = F.col("tok").bitwiseAND(F.lit(-SPANS)).bitwiseOR(F.col("span").cast("long")).alias("tok")
    # Columns that can't be null get no filters, which would make two exchanges of one.
    rows = _prefix_rows(marked, "span").select(spanned, *_ROW)
    rows = rows.select(*(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in rows.columns)).repartition("tok")
    long, short = _unpacked("x"), _unpacked("e")
    n, m = long["n"], short["n"]
    # Of two lines of one id either may come first, which their verification decides.
    x_later, e_later = F.col("x.d") > F.col("e.d"), F.col("x.d") < F.col("e.d")
    over = F.when(x_later, long["done"]).when(e_later, short["done"]).otherwise(long["done"] * short["done"])
    once = (m < n) | ((m == n) & (short["key"] < long["key"]))
    on = (F.col("x.tok") == F.col("e.tok")) & _fits(long | {"done": F.lit(0)}, short) & once & (over == 0)
    ends = [F.when(e_later, F.col(f"e.{c}")).otherwise(F.col(f"x.{c}")).alias(c) for c in ("key", "d")] + [F.when(e_later, F.col(f"x.{c}")).otherwise(F.col(f"e.{c}")).alias(f"e{c}") for c in ("key", "d")]
    met = rows.alias("x").join(_filed(rows).alias("e").hint("merge"), on).select(*ends, m.alias("least"), _differ(long, short).alias("differ"))
    counted = met.groupBy("key", "ekey", "d", "ed").agg(F.count("*").alias("times"), F.first("least").alias("least"), F.first("differ").alias("differ"))
    found = counted.where(F.col("times") >= _shared(F.col("least")))
    there, back = F.struct("key", "ekey"), F.struct(F.col("ekey").alias("key"), F.col("key").alias("ekey"))
    return found.select(F.explode(F.when(F.col("d") == F.col("ed"), F.array(there, back)).otherwise(F.array(there))).alias("both"), "d", "ed", "differ").select("both.key", "both.ekey", "d", "ed", "differ")


def _asked(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, at, line): the lines whose key occurs in ``pairs``, and some others.

    Documents and their lines are held against a bitmap of fixed size over the ids and keys asked for; one that is set by chance costs a row.
    """
    spot = lambda key: F.shiftrightunsigned(key, 40).bitwiseAND(F.lit(LINE_BITS - 1))
    asked = pairs.select(F.explode(F.array(spot("key"), spot("ekey"), spot(F.xxhash64("d")), spot(F.xxhash64("ed")))).alias("b"))
    words = asked.groupBy(F.shiftright("b", 6).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b").bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toArrow()
    found = dict(zip(words.column("w").to_pylist(), words.column("bits").to_pylist(), strict=True))
    bitmap = _held(docs.sparkSession, [found.get(w, 0) for w in range(LINE_BITS // 64)])
    held = lambda key: F.call_function("shiftright", F.get(bitmap, F.shiftright(spot(key), 6).cast("int")), spot(key).bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    lines = _lines(docs.where(held(F.xxhash64(_doc(id_col)))), id_col, text_col).withColumn("key", _key())
    return lines.where(held("key")).select("key", F.struct("d", "h", "p").alias("at"), "line")


def _verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The distinct (d, h, p, key) of later lines whose pair (key, ekey) matches in full."""
    left = pairs.select("key", "ekey").join(lines, "key").select("key", "ekey", "at", F.col("line").alias("own"))
    both = left.join(lines.select(F.col("key").alias("ekey"), F.col("at").alias("eat"), "line"), "ekey").where("eat < at")
    # The sets are bound once: a filter that named them twice would split both lines twice.
    sets = F.array(F.struct(tokens(F.col("own")).alias("x"), tokens(F.col("line")).alias("y")))
    alike = F.exists(sets, lambda s: 9 * F.size(F.array_intersect(s.x, s.y)) >= 4 * (F.size(s.x) + F.size(s.y)))
    return both.where(alike).select("at.*", "key").distinct()


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, h, p): id, hash of the text and position of every line that matches an earlier one; a written table."""
    sets = written(_sets(docs, id_col, text_col, rarity(docs, text_col, sampled=1)), "line-sets")
    firsts = sets.where("not copy").select("d", _key().alias("key"), "n", "sig", "fine", "keys")
    hot = written(_hot(firsts), "line-hot")
    heads = written(_heads(firsts, hot), "line-heads")
    asked = written(_asked(heads, docs, id_col, text_col), "line-heads-asked")
    near = written(_verified(heads, asked), "line-near")
    pairs = written(_pairs(firsts, near.select("key").distinct()), "line-pairs")
    lines = written(_asked(pairs, docs, id_col, text_col), "line-asked")
    # One match is enough: the likeliest partner of each line is verified first, the others only if that fails.
    likeliest = pairs.groupBy("key").agg(F.min(F.struct("differ", "ekey")).alias("e")).select("key", "e.ekey")
    first = written(_verified(likeliest, lines), "line-first")
    rest = pairs.join(first.select("key").distinct(), "key", "left_anti").join(likeliest, ["key", "ekey"], "left_anti")
    rest = written(_verified(rest.select("key", "ekey"), lines), "line-rest")
    place = ["d", "h", "p"]
    gone = sets.where("copy").select(*place)
    for found in (near, first, rest):
        gone = gone.unionByName(found.select(*place))
    return dropped(written(gone.distinct(), "line-gone"), sets, hot, heads, asked, near, pairs, lines, first, rest)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` without the lines that match an earlier line; ``count_col`` names a column for how many went."""
    names = {c.lower() for c in docs.columns}
    gone, key, own = (next(f"{x}{k}" for k in range(1000) if not {f"{x}{k}", f"{x}{k}h"} & names) for x in ("_gone", "_key", "_own"))
    text = F.col(f"`{text_col}`")
    lists = removed_lines(docs, id_col, text_col).groupBy(F.col("d").alias(key), F.col("h").alias(f"{key}h")).agg(F.collect_list("p").alias(gone))
    joined = docs.withColumns({own: _doc(id_col), f"{own}h": F.xxhash64(text.cast("string"))})
    joined = joined.join(lists, (F.col(own) == F.col(key)) & (F.col(f"{own}h") == F.col(f"{key}h")), "left")
    kept = F.when(F.col(gone).isNull() | text.isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(F.col(gone), i)), "\n"))
    count = [] if count_col is None else [F.coalesce(F.when(text.isNotNull(), F.size(gone)), F.lit(0)).alias(count_col)]
    return joined.select(*(kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns), *count)
