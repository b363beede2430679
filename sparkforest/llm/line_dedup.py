"""Near-duplicate lines across all documents: an exact set-similarity join, from DataFrame functions alone.

A line's tokens (distinct words) are ordered by rarity. Two sets with Jaccard similarity of at least t share
a token among the first n - ceil(t n) + 1 of each; lengths and places of that token bound the overlap further.
A bitmap of each set bounds the difference of two sets once more. Only what passes is compared token by token.
Lines with the same tokens form a class, and only classes are joined, so a line that is repeated a million times
is one row of the join. Prefixes and bitmaps move, whole token lists only where a pair is verified.

A class is settled once one earlier class is known to be similar: it isn't looked up any more, though others are
still compared with it. So classes are first compared with a hub of those that begin or end alike, which settles
most of a large group of variants of one line, and the join looks for what is left.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkforest.llm._util import WORD_BREAK, Scratch, free
from sparkforest.llm.quality_rules import let

#: Distinct words of a line that is compared, at least.
LEAST_WORDS = 1
PERCENT = 80
#: Words are counted by slots of their hashes, which bounds what is sent to the tasks: a word is as frequent as its
#: slot. A slot has one of 128 levels, LEVELS to a doubling, and words of a level have the order of their hashes. The
#: join is exact with any one order.
SLOT_BITS, LEVELS = 18, 4
#: So many slots are frequent: their tokens are joined by size as well, which leaves out partners that no length
#: filter would pass. The result is the same with any number.
FREQUENT = 1 << 16
#: Documents that are sent to all tasks at most (their keys and places, about 100 bytes each); more are joined.
BROADCAST = 200_000
#: Words at the beginning and the end of a line by which hubs are found.
ENDS = 4


def words_of(line: Column) -> Column:
    """A line's words in order. Other white space than spaces is rare; such lines alone take the slower pattern."""
    odd = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\v")) | F.contains(line, F.lit("\f")) | F.contains(line, F.lit("\r"))
    return F.array_remove(F.when(odd, F.split(line, WORD_BREAK)).otherwise(F.split(line, " ")), "")


def slot_levels(docs: DataFrame, text: str = "text") -> DataFrame:
    """(levels): one row, the level of each slot by the words of all texts that fall in it; the rarest is 0."""
    words = docs.select(F.explode(words_of(F.replace(text, F.lit("\n"), F.lit(" ")))).alias("w"))
    slot = F.xxhash64("w").bitwiseAND(F.lit((1 << SLOT_BITS) - 1))
    counts = words.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"))
    level = F.least(F.lit(127), F.floor(LEVELS * F.log2(1 + F.coalesce("n", F.lit(0))))).cast("byte")
    # As many rows as there are slots, however many words.
    every = docs.sparkSession.range(1 << SLOT_BITS).select(F.col("id").alias("slot")).join(counts, "slot", "left")
    rows = F.sort_array(F.collect_list(F.struct("slot", level.alias("level"))))
    return every.agg(rows.alias("rows")).select(F.col("rows.level").alias("levels"))


def with_levels(df: DataFrame, levels: DataFrame) -> DataFrame:
    """``df`` and ``_levels``, the one value of ``levels``. A subquery and not a literal, which each description of a
    plan would spell out on the driver. To be used in the next projection, which takes it in and copies nothing."""
    return df.withColumn("_levels", levels.scalar())


def by_rarity(words: Column, levels: Column) -> Column:
    """Tokens of a line's distinct words in the order of rarity: a token is the slot's level, then the rest of the word's
    hash. Numbers are sorted, without their words: sorting pairs of both was a quarter of the pass over lines."""
    slot = lambda h: h.bitwiseAND(F.lit((1 << SLOT_BITS) - 1)).cast("int")
    number = lambda h: F.shiftleft(F.get(levels, slot(h)).cast("long"), 56).bitwiseOR(F.shiftrightunsigned(h, 8))
    return F.sort_array(F.transform(F.transform(words, lambda w: F.xxhash64(w)), number))


def prefix(tokens: Column, n: Column, share: float) -> Column:
    """The first tokens of a set of n, of which another set that has ``share`` of n in common has at least one. They
    are keys of a join, for which 32 bits do: two tokens of one key are only compared in vain."""
    return F.transform(F.slice(tokens, F.lit(1), n - F.ceil(n * share - 1e-9).cast("int") + 1), lambda t: F.shiftright(t, 32).cast("int"))


def wide_bitmap(tokens: Column) -> Column:
    """As ``bitmap`` with 256 parities, in an array of four."""
    part = lambda k: F.filter(tokens, lambda t: F.shiftright(t, 6).bitwiseAND(F.lit(3)) == k)
    return F.array(*[bitmap(part(k)) for k in range(4)])


def bitmap(tokens: Column) -> Column:
    """64 parities; in two sets' bitmaps no more bits differ than there are tokens in only one of the sets."""
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda seen, t: seen.bitwiseXOR(bit(t)))


def double_bitmap(tokens: Column) -> Column:
    """Two bitmaps, of the tokens with an even and an odd seventh bit: 128 parities. In 64, lines of 100 words and more
    differ by about 32 whatever they are, which is as much as near ones may."""
    part = lambda k: F.filter(tokens, lambda t: F.shiftright(t, 6).bitwiseAND(F.lit(1)) == k)
    return F.struct(bitmap(part(0)).alias("x"), bitmap(part(1)).alias("y"))


def hub_pairs(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(earlier, later): each class and the earliest and the most frequent class that begin or end as it does."""
    keys = classes.select("c", "n", "m", F.explode(F.array("head", "tail")).alias("key"))
    one = F.struct("c", "n")
    hubs = keys.groupBy("key").agg(F.count("*").alias("of"), F.min_by(one, "c").alias("first"), F.max_by(one, F.struct("m", -F.col("c"))).alias("most")).where("of > 1")
    each = hubs.select("key", F.explode(F.array_distinct(F.array("first", "most"))).alias("hub"))
    near = (F.col("hub.c") < F.col("c")) & (100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n"))
    return keys.join(each, "key").where(near).select(F.col("hub.c").alias("earlier"), F.col("c").alias("later")).distinct()


def meetings(classes: DataFrame, percent: int = PERCENT, often_from: int = 0) -> DataFrame:
    """(a, b), a pair once for each run of common tokens: classes (c, n tokens, bitmap, prefix, open) that may have a Jaccard similarity of at least
    ``percent``, where the later one is open."""
    rare, often = meetings_apart(classes, percent, often_from)
    return rare.union(often)


def meetings_apart(classes: DataFrame, percent: int = PERCENT, often_from: int = 0) -> tuple[DataFrame, DataFrame]:
    """``meetings`` by rare tokens, and by frequent ones.

    Of a pair, ``a`` is the set that isn't larger. Overlap is at least ``percent`` of the larger set, and 2t / (1 + t)
    of the smaller, so the smaller one needs the shorter prefix. For frequent tokens, sizes go into the key of the
    join as powers of 1 / t: a larger partner is of the same power or the next. ``often_from``: their least level.
    """
    frequent = F.shiftright("token", 24) >= often_from
    # Most of what is shuffled: size, place and whether the class is open are one number.
    entries = classes.select("c", "n", F.col("bitmap.x").alias("x"), F.col("bitmap.y").alias("y"), "open", "prefix", F.posexplode("prefix").alias("i", "token"))
    packed = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.shiftleft("i", 1).cast("long")).bitwiseOR(F.col("open").cast("long"))
    entries = entries.select("token", "c", packed.alias("s"), "x", "y", F.get("prefix", F.col("i") - 1).alias("p"))
    sides = lambda e: (e.toDF("token", "a", "sa", "xa", "ya", "pa"), e.toDF("token", "b", "sb", "xb", "yb", "pb"))
    size, at, is_open = (lambda s: F.shiftright(s, 32).cast("int")), (lambda s: F.shiftright(F.col(s).bitwiseAND(F.lit((1 << 32) - 1)), 1).cast("int")), (lambda s: F.col(s).bitwiseAND(F.lit(1)) == 1)
    na, nb, ia, ib = size("sa"), size("sb"), at("sa"), at("sb")
    # How far the token stands before the end of the shorter prefix, and how much more overlap than needed is
    # possible: what stands before it in the shorter place, it, and what follows in both. One expression of both
    # sides, so that it stays in the join and the two sides share one shuffle.
    inside = na - F.ceil(na * (2 * percent / (100 + percent)) - 1e-9).cast("int") - ia
    most = F.least(na - ia, nb - ib) + F.least(ia, ib)
    place = F.least(inside, most * (100 + percent) - percent * (na + nb)) >= 0
    length = (100 * na >= percent * nb) & ((na < nb) | ((na == nb) & (F.col("a") < F.col("b"))))
    differ = (F.bit_count(F.col("xa").bitwiseXOR(F.col("xb"))) + F.bit_count(F.col("ya").bitwiseXOR(F.col("yb")))) * (100 + percent) <= (100 - percent) * (na + nb)
    # Where the tokens before are one as well, the pair is found by these: sizes and bitmaps are the same, and so is what
    # ``place`` says of places that are both one less, or more. So a run of common tokens makes one row.
    again = F.coalesce(F.col("pa") == F.col("pb"), F.lit(False))
    fits = length & place & ~again & F.when(F.col("a") > F.col("b"), is_open("sa")).otherwise(is_open("sb")) & differ
    small, large = sides(entries.where(~frequent))
    rare = small.join(large, "token").where(fits).select("a", "b")
    small, large = sides(entries.where(frequent))
    power = lambda n: F.floor(F.log(n) / (-math.log(percent / 100) * (1 + 1e-6))).cast("int")
    small = small.where(inside >= 0).withColumn("power", F.explode(F.array(power(na), power(na) + 1)))
    often = small.join(large.withColumn("power", power(nb)), ["token", "power"]).where(fits).select("a", "b")
    return rare, often


def in_order(pairs: DataFrame) -> DataFrame:
    """(earlier, later) of pairs (a, b), each pair once."""
    return pairs.select(F.least("a", "b").alias("earlier"), F.greatest("a", "b").alias("later")).distinct()


def candidates(classes: DataFrame, percent: int = PERCENT, often_from: int = 0) -> DataFrame:
    """(earlier, later) of ``meetings``, each pair once."""
    return in_order(meetings(classes, percent, often_from))


def settled(scratch: Scratch, docs: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int, key: str, text: str) -> DataFrame:
    """(c): later classes of ``pairs`` (earlier, later) whose sets of words reach ``percent``.

    Only the classes of the pairs have their words made again, from the first line of each: documents are joined
    with the places they are asked for, and a place's line is taken from the text.
    """
    asked = pairs.select(F.col("earlier").alias("c")).union(pairs.select("later")).distinct().join(classes.select("c", "first"), "c")
    asked = asked.groupBy(F.col("first.k").alias("_k"), F.col("first.d").alias("_d")).agg(F.collect_list(F.struct("c", F.col("first.i").alias("i"))).alias("_places"))  # as many as the text has lines at most
    asked = scratch.store(asked)
    places = F.broadcast(asked) if asked.count() <= BROADCAST else asked
    full = docs.select(F.col(key).alias("_k"), F.col(text).alias("_x")).where("_x is not null")
    full = full.join(places, (full["_k"] == places["_k"]) & (F.xxhash64(full["_x"]) == places["_d"]))
    lines = full.select(F.split("_x", "\n").alias("_x"), F.explode("_places").alias("_p")).select("_p.c", F.get("_x", F.col("_p.i")).alias("line"))
    made = lambda w: F.struct(F.size(w).alias("n"), let(F.transform(w, lambda x: F.xxhash64(x)), wide_bitmap).alias("wide"), w.alias("words"))
    words = scratch.store(lines.select("c", let(F.array_distinct(words_of(F.col("line"))), made).alias("s")).select("c", "s.n", "s.wide", "s.words").dropDuplicates(["c"]))
    # Bitmaps of 256 bits are compared before words move; what decides are the words themselves.
    side = lambda x, what, name: words.select(F.col("c").alias(x), F.col("n").alias(f"n_{x}"), F.col(what).alias(f"{name}_{x}"))
    both = pairs.join(side("earlier", "wide", "w"), "earlier").join(side("later", "wide", "w"), "later")
    differ = sum((F.bit_count(F.col("w_earlier")[k].bitwiseXOR(F.col("w_later")[k])) for k in range(1, 4)), F.bit_count(F.col("w_earlier")[0].bitwiseXOR(F.col("w_later")[0])))
    near = scratch.store(both.where(differ * (100 + percent) <= (100 - percent) * (F.col("n_earlier") + F.col("n_later"))).select("earlier", "later"))
    full = near.join(side("earlier", "words", "t"), "earlier").join(side("later", "words", "t"), "later")
    shared = F.size(F.array_intersect("t_earlier", "t_later"))
    found = scratch.store(full.where(shared * (100 + percent) >= percent * (F.col("n_earlier") + F.col("n_later"))).select(F.col("later").alias("c")).distinct())
    scratch.drop(asked)
    scratch.drop(words)
    scratch.drop(near)
    return found


def _repeated(docs: DataFrame, key: str, text: str, percent: int, least_words: int) -> DataFrame:
    """(``_k``, ``_d``, line_no): key, digest of the text and place of each line that has an earlier similar one."""
    scratch = Scratch(docs.sparkSession)
    levels = scratch.store(slot_levels(docs, text))
    often_from = levels.select(F.get(F.sort_array("levels"), F.lit((1 << SLOT_BITS) - FREQUENT))).first()[0]
    # SHA-256 of the distinct words, sorted, names the class: words have no white space, and no two sets are known to
    # share it. Tokens are hashes of words, by which candidates are found; they decide nothing.
    name = lambda d: F.unhex(F.sha2(F.array_join(F.sort_array(d), " "), 256)).alias("x")
    some = lambda w, start, seed: F.xxhash64(F.slice(w, start, ENDS), F.lit(seed))
    ends = lambda w: (some(w, 1, 1).alias("head"), some(w, F.greatest(F.size(w) - (ENDS - 1), F.lit(1)), 2).alias("tail"))
    digest = lambda w, d, t: F.struct(name(d), F.size(t).alias("n"), double_bitmap(t).alias("bitmap"), prefix(t, F.size(t), percent / 100).alias("prefix"), *ends(w))
    sized = lambda w: let(F.array_distinct(w), lambda d: F.when(F.size(d) >= max(1, least_words), let(by_rarity(d, F.col("_levels")), lambda t: digest(w, d, t))))
    lines = docs.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.xxhash64(text).alias("_d"), F.posexplode(F.split(text, "\n")).alias("line_no", "_line"))
    # Stored before the filter, which would else compute the tokens a second time.
    made = scratch.store(with_levels(lines, levels).select("_k", "_d", "line_no", let(words_of(F.col("_line")), sized).alias("s")))
    lines = made.where("s is not null")
    place = F.struct(F.col("_k").alias("k"), F.col("line_no").alias("i"), F.col("_d").alias("d"))
    classes = lines.groupBy("s.x").agg(F.min(place).alias("first"), F.count("*").alias("m"), *[F.first(f"s.{c}").alias(c) for c in ("n", "bitmap", "prefix", "head", "tail")])
    # Numbered in the order of their first lines, so that the smaller number is the earlier class.
    classes = scratch.store(classes.repartitionByRange("first").sortWithinPartitions("first").withColumn("c", F.monotonically_increasing_id()))
    # The lines' prefixes aren't needed any more, only those of classes.
    placed = scratch.store(lines.select("_k", "_d", "line_no", "s.x"))
    scratch.drop(made)
    hubs = scratch.store(hub_pairs(classes, percent))
    by_hub = settled(scratch, docs, classes, hubs, percent, key, text)
    opened = classes.select("c", "n", "bitmap", "prefix").join(by_hub.withColumn("_done", F.lit(True)), "c", "left").withColumn("open", F.col("_done").isNull())
    # One after the other, so that the entries of only one join are on disk at a time.
    parts = [scratch.store(in_order(part)) for part in meetings_apart(opened, percent, often_from)]
    maybe = scratch.store(parts[0].union(parts[1]).distinct().join(hubs, ["earlier", "later"], "left_anti"))
    others = settled(scratch, docs, classes, maybe, percent, key, text)
    scratch.drop(levels)
    # A settled class has an earlier similar line; a class's later lines have its first one.
    done = by_hub.union(others).distinct().withColumn("_done", F.lit(True))
    heads = classes.join(done, "c", "left").where("m > 1 or _done").select("x", "first", F.coalesce("_done", F.lit(False)).alias("_done"))
    # Stored, since the tables that it comes from are of the size of the input.
    out = scratch.store(placed.join(heads, "x").where(F.col("_done") | (F.col("first") < place)).select("_k", "_d", "line_no").distinct())
    for df in (placed, classes, hubs, by_hub, *parts, maybe, others):
        scratch.drop(df)
    return out


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """(key, line_no) of lines that have an earlier line, by (key, line_no), with at least ``percent`` similarity.

    Earlier lines count whether or not they are removed themselves. Lines with fewer than ``least_words``
    distinct words, and lines without any, neither remove nor are removed; nor do those of rows with a null key. Of
    rows that repeat a key, lines at equal places follow the digests of their texts; rows that repeat a key and a text
    are one document.
    """
    return _repeated(docs, key, text, percent, least_words).select(F.col("_k").alias(key), "line_no").distinct()


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, and ``n_removed``. All other columns and rows stay.

    A null or empty text stays as it is. A text whose every line is removed becomes empty. Null keys: such rows
    neither remove lines nor lose any. Rows that repeat a key lose their own repeated lines only.
    """
    k, d, lines = (free(c, docs.columns) for c in ("_gone_key", "_gone_digest", "_gone"))
    gone = _repeated(docs, key, text, percent, least_words).groupBy(F.col("_k").alias(k), F.col("_d").alias(d)).agg(F.collect_set("line_no").alias(lines))
    # A document's own lines only: the set is no longer than its text.
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(lines, i)), "\n")
    out = docs.join(gone, (docs[key] == gone[k]) & (F.xxhash64(docs[text]) == gone[d]), "left")
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text and c.lower() != "n_removed"]
    new = F.when(F.col(lines).isNull() | F.col(text).isNull(), F.col(text)).otherwise(kept)
    return out.select(*rest, new.alias(text), F.coalesce(F.size(lines), F.lit(0)).alias("n_removed"))


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """(doc_id, line_no) of every line that is removed from ``documents``."""
    return repeated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: Brute force in SQL: lines that share a word of the exact rarity prefix, verified on full sets.
OP4_SQL = r"""
with l as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no
  from documents where text is not null
), w as (
  select doc_id, line_no, list_sort(list_distinct(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) as ws from l
), s as (
  select ws, min((doc_id, line_no)) as first_at, row_number() over (order by ws) as c, len(ws) as n from w where len(ws) >= 1 group by ws
), t as (
  select c, n, unnest(ws) as token from s
), df as (
  select token, count(*) as df from t group by token
), r as (
  select c, n, token, row_number() over (partition by c order by df, token) as pos from t join df using (token)
), p as (
  select c, n, token from r where pos <= n - ceil(0.8 * n) + 1
), pairs as (
  select distinct a.c as a, b.c as b from p a join p b on a.token = b.token and a.c <> b.c and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), near as (
  select a, b from pairs join s x on x.c = a join s y on y.c = b
  where 180 * len(list_intersect(x.ws, y.ws)) >= 80 * (x.n + y.n)
), earliest as (
  select s.c, s.ws, least(s.first_at, coalesce(min(o.first_at), s.first_at)) as best
  from s left join near on near.a = s.c left join s o on o.c = near.b group by s.c, s.ws, s.first_at
)
select doc_id, cast(line_no as int) as line_no from w join earliest using (ws) where earliest.best < (doc_id, line_no)
"""
