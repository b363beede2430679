"""Quality rules from DataFrame functions alone: counts, and Jensen-Shannon distances of a document's
character-class and common-word histograms to references of each language."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkforest.llm._util import WORD_BREAK, Scratch, free

#: Rules of the base, as the query's contract states them.
LEAST_WORDS, WINDOW, REPEAT_PERCENT = 10, 5, 20
#: Most distance (square root of the divergence in bits) to the nearest language reference. Shorter documents than
#: the guards don't have histograms worth comparing.
GUARD_CHARS, MOST_CHARS = 150, 0.27
#: Short texts hit common words by chance; longer ones are nearer to their language, and a text without any common
#: word is at 0.35 from a language in which these are a quarter of all words.
GUARD_WORDS, MOST_WORDS = 25, 0.46
GUARD_MANY, MOST_MANY = 100, 0.33
#: Common words of a language.
COMMON = 25
_CLASSES = ("upper", "digit", "space", "symbol", "punctuation", "other")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WORD_BREAK), lambda w: w != "")


def repeated_places(windows: Column) -> Column:
    """Places of the windows that are equal to another one, in order: sorted with their places, they are its neighbours."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.sort_array(let(pairs, lambda s: F.filter(F.transform(s, lambda x, k: F.when((F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull())))


def covered_words(at: Column, width: int = WINDOW) -> Column:
    """Words in windows at these places: a place covers ``width`` words, or as many as there are up to the next place."""
    return F.aggregate(F.transform(at, lambda i, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1) - i, F.lit(width)))), F.lit(0), lambda a, x: a + x).cast("long")


def repeated_words(words: Column, width: int = WINDOW, window: Callable[..., Column] = F.xxhash64) -> Column:
    """Words in windows of ``width`` words that are found twice or more, the first included. ``words`` may be hashes;
    ``window`` makes one value of a window's words."""

    def count(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(repeated_places(windows), lambda at: covered_words(at, width)))

    found = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: window(*[F.get(words, i + k) for k in range(width)]))
    return F.when(F.size(words) <= width, F.lit(0).cast("long")).otherwise(let(found, count))


def confirmed_repeats(words: Column, hashes: Column) -> Column:
    """``repeated_words`` by the hashes; where these find some, windows that share a hash are compared by their words. As
    many different windows as hashes among them: no two unlike ones share one. Else all windows are counted by words. Words
    have no white space, so a window is its words with spaces between."""
    text = lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(WINDOW)])
    windows = F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))

    def confirmed(found: Column, at: Column) -> Column:
        sound = F.size(F.array_distinct(F.transform(at, text))) == F.size(F.array_distinct(F.transform(at, lambda i: F.get(found, i))))
        return F.when(sound, covered_words(at)).otherwise(repeated_words(words, window=lambda *w: F.concat_ws(" ", *w)))

    def count(found: Column) -> Column:
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0).cast("long")).otherwise(let(repeated_places(found), lambda at: confirmed(found, at)))

    return F.when(F.size(hashes) <= WINDOW, F.lit(0).cast("long")).otherwise(let(windows, count))


def repeated_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def class_counts(text: Column) -> Column:
    """Struct with the characters of each class; ``other`` holds letters that aren't upper case and all else."""
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("long")
    found = F.array(left(r"\P{Lu}+"), left(r"[^0-9]+"), left(r"[^\x20\x09-\x0D]+"), left(r"[^#*$%&|<>]+"), left(r"[^!\"'()+,\-./:;=?@\[\\\]^_`{}~]+"), F.length(text).cast("long"))

    def named(x: Column) -> Column:
        return F.struct(*[F.get(x, F.lit(i)).alias(c) for i, c in enumerate(_CLASSES[:-1])], (F.get(x, F.lit(5)) - sum((F.get(x, F.lit(i)) for i in range(1, 5)), F.get(x, F.lit(0)))).alias("other"))

    return let(found, named)


def word_counts(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, word, n) over all rows with a language."""
    named = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("_t"))
    words = named.select("lang", F.explode(F.split("_t", WORD_BREAK)).alias("word")).where("word <> ''")
    return words.groupBy("lang", "word").agg(F.count("*").alias("n"))


def common_words(counts: DataFrame, n: int = COMMON) -> DataFrame:
    """(lang, word, n): the n most frequent words of each language; of equal counts, the first in order."""
    rank = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    return counts.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= n).drop("rank")


def class_shares(docs: DataFrame, counts: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, words, one share for each character class) over all rows of a language. Characters of words are
    counted once for each distinct word; what texts have besides is white space."""
    size = docs.where(F.col(lang).isNotNull()).groupBy(F.col(lang).alias("lang")).agg(F.sum(F.length(text)).alias("_all"))
    inside = counts.select("lang", "n", class_counts(F.col("word")).alias("_c"))
    sums = inside.groupBy("lang").agg(F.sum("n").alias("words"), *[F.sum(F.col("n") * F.col(f"_c.{c}")).alias(c) for c in _CLASSES])
    sums = sums.join(F.broadcast(size), "lang")  # a row for each language
    total = sum((F.col(c) for c in _CLASSES[1:]), F.col("upper"))
    return sums.withColumn("space", F.col("_all") - total).select("lang", "words", *[(F.col(c) / F.col("_all")).alias(c) for c in _CLASSES])


def distance(p: Column, q: Column | list[float]) -> Column:
    """Jensen-Shannon distance of shares, 0 to 1."""
    part = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))
    terms = F.zip_with(p, F.lit(q) if isinstance(q, list) else q, lambda x, y: part(x, y) + part(y, x))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))


def _constant(value: list, kind: str) -> Column:
    """An array that is one string in the plan and folded once, so that the plan doesn't grow with the languages."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _nearest(p: Column, references: list[list[float]]) -> Column:
    if not references:
        return F.lit(0.0)
    return let(p, lambda x: F.array_min(F.transform(_constant(references, "array<array<double>>"), lambda q: distance(x, q))))


class References:
    """The histograms of each language: a row of shares a language, small whatever the corpus."""

    def __init__(self, docs: DataFrame, lang: str = "lang", text: str = "text"):
        scratch = Scratch(docs.sparkSession)
        counts = scratch.store(word_counts(docs, lang, text))
        total = sorted(class_shares(docs, counts, lang, text).collect(), key=lambda r: r["lang"])
        self.classes = [[float(r[c]) for c in _CLASSES] for r in total]
        rows = common_words(counts).withColumn("hash", F.xxhash64("word")).collect()
        scratch.drop(counts)
        self.hashes = sorted({r["hash"] for r in rows})
        place = {h: i for i, h in enumerate(self.hashes)}
        self.shares = []
        for t in total:
            own = [0.0] * len(self.hashes)
            for r in rows:
                if r["lang"] == t["lang"]:
                    own[place[r["hash"]]] = r["n"] / t["words"]
            self.shares.append([*own, max(0.0, 1 - sum(own))])
        self.slots = slots_of(self.hashes)


def places(h: int, size: int) -> tuple[int, int]:
    """The two places of a hash in a table of ``size`` slots, a power of two."""
    return h % size, (h >> 24) % size


def slots_of(hashes: list[int]) -> list[int]:
    """A table of 4 to 8 slots a hash: each slot has the number of a hash or -1, each hash is in one of its two places.
    A hash that finds both taken moves one of the others on."""
    size = max(256, 1 << (4 * len(hashes)).bit_length())
    while True:
        slots = [-1] * size
        for i in range(len(hashes)):
            at, turns = places(hashes[i], size)[0], 0
            while i >= 0 and turns < 500:
                one, other = places(hashes[i], size)
                at = one if slots[one] < 0 else other if slots[other] < 0 else (other if at == one else one)
                i, slots[at], turns = slots[at], i, turns + 1
            if i >= 0:
                break
        else:
            return slots
        size *= 2


def word_distance(hashes: Column, ref: References) -> Column:
    """From the words' hashes. Each common word becomes one private-use character, so that counting is by length."""
    if not ref.shares:
        return F.lit(0.0)
    # Planes 15 and 16 have more private-use characters than there are common words of all written languages.
    marks = [chr(0xE000 + i if i < 6400 else 0xF0000 + i) for i in range(len(ref.hashes))]
    size = len(ref.slots)
    slot_hash = _constant([ref.hashes[i] if i >= 0 else 0 for i in ref.slots], "array<long>")
    slot_mark = _constant([marks[i] if i >= 0 else "" for i in ref.slots], "array<string>")
    one = lambda h: h.bitwiseAND(F.lit(size - 1)).cast("int")
    other = lambda h: F.shiftright(h, 24).bitwiseAND(F.lit(size - 1)).cast("int")
    mark = lambda h: F.when(F.get(slot_hash, one(h)) == h, F.get(slot_mark, one(h))).when(F.get(slot_hash, other(h)) == h, F.get(slot_mark, other(h))).otherwise("")
    found = F.array_join(F.transform(hashes, mark), "")
    n = F.size(hashes).cast("double")

    def shares(s: Column) -> Column:
        each = F.transform(_constant(marks, "array<string>"), lambda c: (F.length(s) - F.length(F.replace(s, c, F.lit("")))) / n)
        return F.concat(each, F.array((n - F.length(s)) / n))

    return _nearest(let(found, shares), ref.shares)


def judge(docs: DataFrame, ref: References, text: str = "text") -> DataFrame:
    """Adds the counts, distances and verdicts to each row; other columns stay, but for clashing names, which are
    replaced. Null and empty texts have no words and fail the base. A row is rejected by a distance only if it
    is long enough for that histogram. Nothing is shuffled."""
    t = F.coalesce(F.col(text), F.lit(""))
    _t, _w, _c, _l = (free(c, docs.columns) for c in ("_t", "_w", "_c", "_l"))
    counted = lambda w, h: F.struct(F.size(h).cast("long").alias("n_words"), confirmed_repeats(w, h).alias("n_repeat_words"), F.when(F.size(h) >= GUARD_WORDS, word_distance(h, ref)).alias("word_distance"))
    found = let(words_of(F.col(_t)), lambda w: let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: counted(w, h)))
    made = docs.withColumn(_t, t).withColumn(_w, found).withColumn(_c, class_counts(F.col(_t))).withColumn(_l, repeated_lines(F.col(_t)))
    n = sum((F.col(f"{_c}.{c}") for c in _CLASSES[1:]), F.col(f"{_c}.upper"))
    shares = F.array(*[F.col(f"{_c}.{c}") / n for c in _CLASSES])
    out = {
        "n_words": F.col(f"{_w}.n_words"),
        "word_chars": n - F.col(f"{_c}.space"),
        "n_symbols": F.col(f"{_c}.symbol"),
        "n_dup_lines": F.col(_l),
        "n_repeat_words": F.col(f"{_w}.n_repeat_words"),
        "char_distance": F.when(n >= GUARD_CHARS, _nearest(shares, ref.classes)),
        "word_distance": F.col(f"{_w}.word_distance"),
    }
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in {*out, "base_failed", "kept"}]
    made = made.select(*rest, *[v.alias(k) for k, v in out.items()])
    made = made.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))
    near = (F.coalesce("char_distance", F.lit(0.0)) <= MOST_CHARS) & (F.coalesce("word_distance", F.lit(0.0)) <= F.when(F.col("n_words") >= GUARD_MANY, MOST_MANY).otherwise(MOST_WORDS))
    return made.withColumn("kept", ~F.col("base_failed") & near)


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = judge(docs.select("doc_id", "text"), References(docs))
    return out.drop("text")
