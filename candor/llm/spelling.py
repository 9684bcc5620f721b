"""Spelling variants: words one edit apart, by bands of letter-parity masks.

Every character has a bit, and a word's mask has the bits of the characters that it holds an odd number of times. One
insertion, deletion or replacement of a character flips at most two bits, so of three bands of the mask at least one stays as it is.
Words meet where a band is equal and their lengths differ by at most one, and an exact check of the edit follows.

Parities of a few letters put very many words into one bucket. But one edit touches one third of a word's places: the other two
thirds, counted from the word's ends, are equal in both words. So a bucket is a band together with two of the thirds, and
nothing is lost: a word is sent under 3 bands and 3 pairs of thirds, and once more each as the longer one of a pair. A pair
that meets in several buckets is taken in the first of them, which follows from its two words, so nothing has to be made distinct.

1. Runs of letters are counted over all texts, combined within tasks before the shuffle, so a frequent word is one row per task.
2. Pairs by an equi-join on bucket, checked, counted for each word, and the best one chosen, by aggregations.
3. A word's root follows its forms to the last. A form's n is at least twice its word's, so a chain has fewer than 64 steps;
   pointers are doubled until none moves, at most 6 times, each round a stored table of the words that have a form.

All is DataFrame functions: no Python in the tasks.

Nulls: a null text has no words; a null doc_id counts as an empty string in `<doc_id>:<run>`. Texts of any length are read whole.
Repeated rows count each time. Ties of n go to the smallest word in code-point order. An empty table gives no words. Other
columns are not read, whatever their names. doc_id can have any type that has a string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
OFTEN, SHORTEST, TIMES = 3, 5, 2
#: Bits of a mask, dealt to the bands in turn: a to z have one each, other characters share the rest by their code points
BITS, BANDS, PARTS = 60, 3, 3


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id (a string) and run: the maximal runs of letters of each text, A-Z in lower case."""
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.select("id", F.explode(F.regexp_extract_all(_lower(F.col("text")), F.lit(f"({RUN})"), 1)).alias("run"))


def misspelt(run: Column, key: Column, every: int = 97) -> Column:
    """The run, or where `every` divides the crc32 h of `<key>:<run>` the run without its code point h % length."""
    h = F.crc32(F.concat(key, F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def counted(words: DataFrame, often: int = OFTEN, shortest: int = SHORTEST) -> DataFrame:
    """word, n of those that are long and frequent enough."""
    return words.where(F.char_length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


def mask(word: Column) -> Column:
    """The bits of the characters that a word holds an odd number of times."""
    code = lambda c: F.when((c >= "a") & (c <= "z"), F.ascii(c) - 97).otherwise(26 + F.pmod(F.crc32(c.cast("binary")), F.lit(BITS - 26)).cast("int"))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), code(c) % BANDS * (BITS // BANDS) + F.floor(code(c) / BANDS).cast("int"))
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda m, c: F.when(c == "", m).otherwise(m.bitwiseXOR(bit(c))))


def _band(m: Column, k: int) -> Column:
    width = BITS // BANDS
    return F.shiftright(m, k * width).bitwiseAND(F.lit((1 << width) - 1))


def _without(size: str, part: int) -> Column:
    """A word without one third of its places; size, SQL: the characters of the shorter word of a pair."""
    before, after = f"{size} * {part} div {PARTS}", f"({size} - {size} * {part + 1} div {PARTS})"
    return F.expr(f"concat(substring(word, 1, {before}), '|', substring(word, char_length(word) - {after} + 1, {after}))")


def _buckets(words: DataFrame, longer: bool) -> DataFrame:
    """A row for each bucket of a word, as the longer one of a pair or not. words: word, n, mask."""
    size = "(char_length(word) - 1)" if longer else "char_length(word)"
    words = words.select("word", "n", "mask", F.array(*[F.hash(F.expr(size), _without(size, p)) for p in range(PARTS)]).alias("parts"))
    slot = [F.struct(F.lit(PARTS * k + p).cast("byte").alias("slot"), F.xxhash64(F.lit(k), F.lit(p), _band(F.col("mask"), k), F.get("parts", F.lit(p))).alias("bucket")) for k in range(BANDS) for p in range(PARTS)]
    rows = words.withColumn("b", F.explode(F.array(*slot))).select("b.bucket", "b.slot", "word", "n", "mask", "parts")
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "bucket")  # few bytes make much work, so they aren't to be coalesced


def _met(a: DataFrame, b: DataFrame, once: Column) -> DataFrame:
    """Pairs of two sides that share a bucket and are one edit apart, in the first bucket that they share."""
    a, b = a.alias("a"), b.alias("b")
    flipped = F.bit_count(F.col("a.mask").bitwiseXOR(F.col("b.mask"))) <= 2
    band = F.coalesce(*[F.when(_band(F.col("a.mask"), k) == _band(F.col("b.mask"), k), k) for k in range(BANDS)])
    part = F.coalesce(*[F.when(F.get("a.parts", F.lit(p)) == F.get("b.parts", F.lit(p)), p) for p in range(PARTS)])
    same = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.slot") == F.col("b.slot"))
    found = a.join(b, same & once & flipped & (F.col("a.slot") == PARTS * band + part) & (F.levenshtein("a.word", "b.word", 1) == 1))
    return found.select(F.col("a.word").alias("a"), F.col("b.word").alias("b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b, n_a, n_b of all words exactly one edit apart, each pair once. words: word (distinct), n, mask."""
    same = _buckets(words, False)
    return _met(same, same, F.col("a.word") < F.col("b.word")).unionByName(_met(same, _buckets(words, True), F.lit(True)))


def forms(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n, n_near (number of near words), form (the near word of largest n, if that is `times` the word's at least) and form_n."""
    pairs = near_pairs(words)
    side = lambda x, y: F.struct(F.col(x).alias("word"), F.col(y).alias("near"), F.col(f"n_{y}").alias("near_n"))
    links = pairs.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("l")).select("l.*")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near")))
    found = links.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    out = words.join(found, "word", "left")
    good = -F.col("best.n") >= times * F.col("n")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.n")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """word and root of the words that have a form, by doubling pointers. formed: a stored table with word and form."""
    at = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n and root of words with their counts."""
    formed = stored(forms(stored(words.withColumn("mask", mask(F.col("word"))), "words"), times), "forms")
    return formed.join(roots(formed), "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, every: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Variants over all texts, with the slips that misspelt() makes; every=0 makes none."""
    found = runs(docs, id_col, text_col)
    word = misspelt(F.col("run"), F.col("id"), every) if every else F.col("run")
    return variants(counted(found.select(word.alias("word")))).select("word", "n", "n_near", "form", "form_n", "root")
