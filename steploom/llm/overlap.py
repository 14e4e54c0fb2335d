"""Same or nearly the same questions on both sides of a split, by similarity-hash fingerprints.

Questions and answers are normalised, and records that agree then form a class with one
representative. A representative's fingerprint has 128 bits: each is the sign of a weighted sum
over the character trigrams of the question's words, words that very many questions use counting
little. Records to be joined must also have the same answer up to typing and the same digits in the
question; the different answers are paired first, by keys of which such answers share one. Only
representatives that have a partner in both then get a fingerprint. It is joined in 8-bit blocks of
TABLES permutations of its bits, of which one block must agree: up to 15 differing bits can't be
missed, and of pairs at the radius four in five are met. Pairs within the Hamming radius are verified on
their words: words may differ by a slip of typing, but not where both are words that the corpus knows.
A word a hundred times rarer than the other isn't known: slips of a frequent word recur as tables grow.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steploom.plans.storage import store

BITS, BLOCKS = 128, 16
TABLES = 2  # permutations of the bits that blocks are taken from
RADIUS = 40
KNOWN = 3  # questions from which on a word counts as one of its own, no slip of another
RARE = 0.01  # share of the questions with another word up to which a word counts as its slip all the same
COMMON = 0.005  # share of the records from which on a word counts little
COMMON_WEIGHT = 0.4
EXPAND = 64
CHUNK = 1024  # records of a class that are paired with as many others at once

# Words whose presence changes nothing that is asked (articles, copulas, which/what,
# and the frame that prompts put around a question).
FILLERS = frozenset(
    "the a an is was are were be both which what in please tell me kindly could can you answer briefly shortly question q retry again "
    "el la los las un una es fue era cuál cual qué que por favor pregunta responde brevemente "
    "le les une est était quel quelle s'il vous plaît svp réponds brièvement "
    "der die das dem den des ein eine einen einem einer eines ist war welche welcher welches welchem bitte frage antworte kurz".replace("'", " ").split()
)
ARTICLES = frozenset("the a an el la los las un una le les une der die das ein eine".split())
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")
_GROUPED = re.compile(r"(?<=[0-9]),(?=[0-9]{3}(?![0-9]))")


def _latin() -> dict[int, str]:
    """Characters that come to ASCII letters without their accents, or that stand between words."""
    out = {}
    for k in range(0x80, 0x2100):
        flat = "".join(c for c in unicodedata.normalize("NFKD", chr(k)) if not unicodedata.combining(c))
        if len(flat) == 1 and flat.isascii() and flat.isalpha():
            out[k] = flat
        elif unicodedata.category(chr(k))[0] in "PZ" and flat == chr(k):
            out[k] = " "
    return out


_LATIN = _latin()


def words_of(text: str | None) -> list[str]:
    """Lower-case words without accents; digits grouped by commas are one word."""
    if text and not text.isascii():
        plain = text.casefold().translate(_LATIN)
    else:
        plain = (text or "").lower()
    if plain.isascii():  # the usual case; what follows is the same for any script
        return _ASCII_WORD.findall(_GROUPED.sub("", plain) if "," in plain else plain)
    text = regex.sub(r"(?<=\p{N}),(?=\p{N}{3}(?!\p{N}))", "", text or "")
    flat = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))
    return _WORD.findall(flat)


_FLAT_FILLERS = frozenset(w for f in FILLERS for w in words_of(f))
_FLAT_ARTICLES = frozenset(w for f in ARTICLES for w in words_of(f))


def content_words(text: str | None) -> list[str]:
    """The words without fillers; all of them if nothing else is there."""
    words = words_of(text)
    return [w for w in words if w not in _FLAT_FILLERS] or words


def plain_answer(text: str | None) -> str:
    """An answer without article, case, accents and punctuation."""
    words = words_of(text)
    return " ".join(words[1:] if len(words) > 1 and words[0] in _FLAT_ARTICLES else words)


def edits(a: str, b: str, most: int) -> int:
    """Damerau-Levenshtein distance (adjacent swaps count one), or most + 1 if beyond."""
    # an edit changes at most two letters of the sets, so most other words need no table
    if abs(len(a) - len(b)) > most or len(set(a) ^ set(b)) > 2 * most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], before[j - 2] + 1)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def typed_alike(a: str, b: str) -> bool:
    """One word up to a slip of typing; two in long ones. Numbers must be equal.

    Words of up to four letters have many neighbours, so there only a swap and a letter left out or
    typed twice are slips, and with less than three letters only a swap.
    """
    if a == b:
        return True
    short = min(len(a), len(b))
    most = 2 if short >= 8 else 1
    if abs(len(a) - len(b)) > most or any(map(str.isnumeric, a + b)):
        return False
    if short <= 4 and len(a) == len(b):
        return sorted(a) == sorted(b) and edits(a, b, 1) <= 1
    return short >= 3 and edits(a, b, most) <= most


def short_slip(typed: str, word: str) -> bool:
    """Whether a swap, or a letter left out or typed twice, makes ``typed`` of the word where one has less than three letters.

    Words that short say little: :class:`SplitOverlap` wants one of them to be RARE beside the other.
    """
    if typed == word or min(len(typed), len(word)) > 2 or any(map(str.isnumeric, typed + word)):
        return False
    if len(typed) == len(word):
        return sorted(typed) == sorted(word) and edits(typed, word, 1) <= 1
    if len(typed) < len(word):
        return typed in {word[:k] + word[k + 1 :] for k in range(len(word))}
    return typed in {word[:k] + word[k] + word[k:] for k in range(len(word))}


def slips(a: list[str], b: list[str]) -> list[tuple[str, str]] | None:
    """The words that must be slips of each other if two questions are the same; None if they can't be.

    The same are questions of the same words in any order, up to typing, fillers and words run
    together or apart. Beside a :func:`short_slip` of a filler stands the empty word.
    """
    x, y = list((Counter(a) - Counter(b)).elements()), list((Counter(b) - Counter(a)).elements())
    found = []
    for word in list(x):
        match = next((other for other in y if typed_alike(word, other)), None)
        if match is not None:
            x.remove(word)
            y.remove(match)
            found.append((word, match))
    if "".join(x) == "".join(y):
        return found
    for word in list(x):
        match = next((other for other in y if short_slip(word, other) or short_slip(other, word)), None)
        if match is not None:
            x.remove(word)
            y.remove(match)
            found.append((word, match))
    if "".join(x) == "".join(y):
        return found
    # the longest first: what is left of different questions is mostly a name, and no filler is as long
    for w in sorted(x + y, key=len, reverse=True):
        if any(typed_alike(w, f) for f in _FLAT_FILLERS if len(f) > 2):
            continue
        if not any(short_slip(w, f) for f in _FLAT_FILLERS):
            return None
        found.append((w, ""))
    return found


def same_question(a: list[str], b: list[str], known: frozenset[str] = frozenset()) -> bool:
    """Whether :func:`slips` are possible and none has a known word on both sides."""
    found = slips(a, b)
    return found is not None and not any(p in known and q in known for p, q in found)


def same_answer(a: str, b: str) -> bool:
    """Equal up to typing, word by word."""
    x, y = a.split(), b.split()
    if len(x) != len(y):
        return "".join(x) == "".join(y)
    return all(typed_alike(p, q) for p, q in zip(x, y, strict=True)) and sum(p != q for p, q in zip(x, y, strict=True)) <= 1


def _variants(word: str) -> set[str]:
    """Strings of which any two words that :func:`typed_alike` accepts share one.

    Up to 26 letters what is left after as many deletions as slips are allowed; from 25 on both ends and
    the middle, one of which two slips leave (the middle moved by one at most).
    """
    n = len(word)
    if n < 2 or any(map(str.isnumeric, word)):
        return set()
    out = set()
    if n <= 26:
        once = {word[:k] + word[k + 1 :] for k in range(n)}
        out = {word} | once | ({w[:k] + w[k + 1 :] for w in once for k in range(n - 1)} if n >= 8 else set())
    if n >= 25:
        out |= {"<" + word[:6], ">" + word[-6:], *("~" + word[k : k + 6] for k in (8, 9, 10))}
    return out


def answer_keys(answer: str) -> list[int]:
    """64-bit keys of which any two answers that :func:`same_answer` accepts share one."""
    words = answer.split()
    keys = [_hash("=" + "".join(words), 0)]
    for k, word in enumerate(words):
        rest = _hash(" ".join(words[:k]) + "\1" + " ".join(words[k + 1 :]), 0)
        keys += [_hash(v, rest) for v in _variants(word)]
    return keys


def _hash(text: str, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed)


def digits_of(question: str) -> str:
    """The numeric characters in order of value, which :func:`same_question` lets no pair differ in."""
    return "".join(sorted(filter(str.isnumeric, question)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_sums(words: list[str]) -> np.ndarray:
    """Per word and bit the sum of the signs of its trigrams."""
    points = np.frombuffer("".join(f"\1{w}\2" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    grams = _mix(_mix(_mix(points[:-2]) + points[1:-1]) + points[2:])
    ends = np.cumsum([len(w) + 2 for w in words])
    out = np.empty((len(words), BITS), np.float32)
    starts = ends - np.array([len(w) + 2 for w in words])
    inside = np.ones(len(points), bool)
    inside[ends - 1] = inside[ends - 2] = False
    place = np.flatnonzero(inside)
    first = np.searchsorted(place, starts)
    for a in range(0, len(words), 2048):
        b = min(a + 2048, len(words))
        part = grams[place[first[a] : first[b] if b < len(words) else len(place)]]
        names = np.stack([part, _mix(part + np.uint64(0x9E3779B97F4A7C15))], axis=1)
        signs = np.unpackbits(names.view(np.uint8).reshape(len(part), BITS // 8), axis=1).astype(np.int16) * 2 - 1
        out[a:b] = np.add.reduceat(signs, first[a:b] - first[a], axis=0)
    return out


def fingerprints(texts: list[list[str]], common: frozenset[str]) -> np.ndarray:
    """128-bit similarity hashes of word lists, as rows of 16 bytes."""
    out = np.zeros((len(texts), BITS // 8), np.uint8)
    for at in range(0, len(texts), 4096):
        part = texts[at : at + 4096]
        words = {w: k for k, w in enumerate(dict.fromkeys(w for t in part for w in t))}
        if not words:
            continue
        sums = _word_sums(list(words)) * np.array([COMMON_WEIGHT if w in common else 1.0 for w in words], np.float32)[:, None]
        index = np.fromiter((words[w] for t in part for w in t), np.int64)
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        row = np.flatnonzero(sizes)
        first = (np.cumsum(sizes) - sizes)[row]
        out[at + row] = np.packbits(np.add.reduceat(sums[index], first, axis=0) > 0, axis=1)
    return out


# the bits that the second table's blocks are made of: those of each place in all of the first's blocks
_PERMUTED = np.arange(BITS).reshape(BLOCKS, BITS // BLOCKS).T.ravel()


def blocks_of(prints: np.ndarray) -> np.ndarray:
    """TABLES * BLOCKS blocks of 8 bits of each fingerprint."""
    return np.concatenate([prints, np.packbits(np.unpackbits(prints, axis=1)[:, _PERMUTED], axis=1)], axis=1)


class SplitOverlap:
    """Overlaps between the training records of a table and its other splits.

    Columns: ``record``, ``split``, ``source``, ``question``, ``answer``. Records with a null
    record, split, question or answer, or an answer without a letter or digit, make no case.
    Repeated rows of a record count once. Columns besides these are not read.
    """

    def __init__(self, df: DataFrame, record: str, split: str, source: str, question: str, answer: str, train: str = "train"):
        spark = df.sparkSession
        rows = df.select(*(F.col(f"`{c}`").cast("string").alias(a) for c, a in ((record, "record"), (split, "split"), (source, "source"), (question, "question"), (answer, "answer"))))
        rows = rows.where(F.col("record").isNotNull() & F.col("split").isNotNull() & F.col("question").isNotNull() & F.col("answer").isNotNull())
        # exact copies are normalised once a task
        def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[tuple[str, str], tuple[str, str]] = {}
            for batch in batches:
                pairs = list(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True))
                if len(known) > 1 << 18:
                    known.clear()
                for pair in pairs:
                    if pair not in known:
                        known[pair] = " ".join(content_words(pair[0])), plain_answer(pair[1])
                q, a = zip(*(known[p] for p in pairs), strict=True) if pairs else ((), ())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(q, pa.string()), pa.array(a, pa.string())], ["record", "split", "source", "q", "a"])

        plain = rows.mapInArrow(normal, "record string, split string, source string, q string, a string").where("q <> '' and a <> ''")
        self.train = train
        self.members = store(plain.distinct().withColumn("key", F.xxhash64("q", "a")).withColumn("seen", F.col("split") == train), "split-members")
        reps = self.members.groupBy("key").agg(F.first("q").alias("q"), F.first("a").alias("a"), F.max("seen").alias("in_train"), F.min("seen").alias("only_train"))
        self.reps = store(reps.select("key", "q", "a", "in_train", (~F.col("only_train")).alias("in_other")), "split-reps")
        self.total = total = self.reps.count()
        self.words = store(self.reps.select(F.explode(F.array_distinct(F.split("q", " "))).alias("w")).groupBy("w").count(), "overlap-words")
        # bounded: a text of n words can hold n / COMMON such words in the mean
        self.common = frozenset(r.w for r in self.words.where(F.col("count") > max(2.0, COMMON * total)).collect())
        self.spark = spark

    def _hashed(self, sides: DataFrame) -> DataFrame:
        """(key, train, piece, digits, f0, f1, f: the blocks) of these representatives."""
        common = self.common

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                prints = fingerprints([q.split() for q in batch.column(4).to_pylist()], common)
                blocks = pa.FixedSizeListArray.from_arrays(pa.array(blocks_of(prints).astype(np.int16).ravel()), TABLES * BLOCKS).cast(pa.list_(pa.int16()))
                words = prints.view(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(words[:, 0].copy()), pa.array(words[:, 1].copy()), blocks], ["key", "train", "piece", "digits", "f0", "f1", "f"])

        return sides.select("key", "train", "piece", "digits", "q").mapInArrow(run, "key long, train boolean, piece long, digits long, f0 long, f1 long, f array<short>")

    def _answers(self) -> DataFrame:
        """(answer, piece): answers of training records, and those of others that may be the same, themselves included."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = [answer_keys(a) for a in batch.column(0).to_pylist()]
                pick = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
                flat = np.array([x for k in keys for x in k], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pick) for c in (1, 2, 3)), pa.array(flat)], ["answer", "in_train", "in_other", "k"])

        each = self.reps.groupBy("a").agg(F.max("in_train").alias("in_train"), F.max("in_other").alias("in_other")).select("a", F.xxhash64("a").alias("answer"), "in_train", "in_other")
        # few bytes make many keys, so the number of tasks isn't left to the bytes
        each = each.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "answer")
        keyed = each.mapInArrow(run, "answer long, in_train boolean, in_other boolean, k long")
        keyed = store(keyed, "answer-keys")
        left, right = keyed.where("in_train").select("k", "answer"), keyed.where("in_other").select("k", F.col("answer").alias("piece"))
        return left.join(right, "k").select("answer", "piece").distinct()

    def near(self) -> DataFrame:
        """(a, b): keys of different classes, a with training records and b with others, that agree."""
        digits = F.xxhash64(F.array_sort(F.split(F.regexp_replace("q", r"\P{N}+", ""), "")))
        reps = self.reps.select("key", "q", "in_train", "in_other", F.xxhash64("a").alias("answer"), digits.alias("digits"))
        left = reps.where("in_train").join(self._answers(), "answer").select("key", "q", "piece", "digits", F.lit(True).alias("train"))
        right = reps.where("in_other").select("key", "q", F.col("answer").alias("piece"), "digits", F.lit(False).alias("train"))
        sides = store(left.union(right), "overlap-sides")
        # a class with itself is no pair, so a side needs a partner of another key
        met = sides.groupBy("piece", "digits").agg(F.min("train").alias("t"), F.max("train").alias("u"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        met = met.where("t <> u and lo <> hi").select("piece", "digits")
        hashed = store(self._hashed(sides.join(met, ["piece", "digits"], "left_semi")), "fingerprints")
        keyed = hashed.select("key", "train", "f0", "f1", "piece", "digits", F.posexplode("f").alias("place", "block"))
        keyed = keyed.select("key", "train", "f0", "f1", F.xxhash64("piece", "digits", "place", "block").alias("bucket"))
        left = keyed.where("train").select("bucket", F.col("key").alias("a"), F.col("f0").alias("x0"), F.col("f1").alias("x1"))
        right = keyed.where("not train").select("bucket", F.col("key").alias("b"), F.col("f0").alias("y0"), F.col("f1").alias("y1"))
        distance = F.bit_count(F.col("x0").bitwiseXOR(F.col("y0"))) + F.bit_count(F.col("x1").bitwiseXOR(F.col("y1")))
        pairs = left.join(right, "bucket").where((F.col("a") != F.col("b")) & (distance <= RADIUS)).select("a", "b").distinct()
        texts = self.reps.select("key", "q", "a")
        pairs = pairs.join(texts.toDF("a", "qa", "aa"), "a").join(texts.toDF("b", "qb", "ab"), "b")

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                qa, aa, qb, ab = (batch.column(c).to_pylist() for c in ("qa", "aa", "qb", "ab"))
                found = [slips(s.split(), t.split()) if same_answer(u, v) else None for s, u, t, v in zip(qa, aa, qb, ab, strict=True)]
                on = batch.filter(pa.array([f is not None for f in found], pa.bool_()))
                fields = pa.struct([("x", pa.string()), ("y", pa.string()), ("short", pa.bool_())])
                words = pa.array([[{"x": p, "y": q, "short": not typed_alike(p, q)} for p, q in f] for f in found if f is not None], pa.list_(fields))
                yield pa.RecordBatch.from_arrays([on.column("a"), on.column("b"), words], ["a", "b", "slips"])

        checked = store(pairs.select("a", "b", "qa", "aa", "qb", "ab").mapInArrow(verify, "a long, b long, slips array<struct<x string, y string, short boolean>>"), "overlap-checked")
        each = checked.select("a", "b", F.explode("slips").alias("s")).select("a", "b", "s.x", "s.y", "s.short")
        # fillers aren't counted; any question may have them
        counts = self.words.union(self.spark.range(1).select(F.lit("").alias("w"), F.lit(self.total).cast("long").alias("count")))
        each = each.join(counts.toDF("x", "nx"), "x").join(counts.toDF("y", "ny"), "y")
        beside = F.least("nx", "ny") > RARE * F.greatest("nx", "ny")
        distinct_words = each.where(beside & (F.col("short") | (F.least("nx", "ny") >= KNOWN))).select("a", "b").distinct()
        return checked.select("a", "b").join(distinct_words, ["a", "b"], "left_anti")

    def classes(self) -> DataFrame:
        """(a, b) of all agreeing classes, those with records on both sides included."""
        both = self.reps.where("in_train and in_other").select(F.col("key").alias("a"), F.col("key").alias("b"))
        return self.near().union(both)

    def pairs(self, first: str, second: str, whole: bool = False) -> DataFrame:
        """Pairs of a training and another record, the smaller id first.

        Where classes of copies are so large that their pairs exceed EXPAND squared, the smallest
        training record stands for its class towards each of the others, and the other way round;
        :meth:`membership` has the rest. With ``whole`` every pair of these classes is given too.
        """
        found = store(self.classes(), "class-pairs")
        sides = self.members.groupBy("key", "seen").agg(F.count("*").alias("n"), F.min("record").alias("low"))
        t = sides.where("seen").select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("low").alias("la"))
        o = sides.where("not seen").select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("low").alias("lb"))
        sized = found.join(t, "a").join(o, "b").withColumn("wide", F.col("na") * F.col("nb") > EXPAND * EXPAND)
        mt = self.members.where("seen").select(F.col("key").alias("a"), F.col("record").alias("x"))
        mo = self.members.where("not seen").select(F.col("key").alias("b"), F.col("record").alias("y"))
        small = sized.where("not wide").select("a", "b").join(mt, "a").join(mo, "b").select("x", "y")
        if whole:
            return self._ordered(small.union(self._crossed(sized.where("wide"))), first, second)
        from_train = sized.where("wide").select("a", F.col("lb").alias("y")).join(mt, "a").select("x", "y")
        from_other = sized.where("wide").select("b", F.col("la").alias("x")).join(mo, "b").select("x", "y")
        return self._ordered(small.union(from_train).union(from_other), first, second)

    @staticmethod
    def _ordered(pairs: DataFrame, first: str, second: str) -> DataFrame:
        return pairs.where("x <> y").select(F.least("x", "y").alias(first), F.greatest("x", "y").alias(second)).distinct()

    def _crossed(self, wide: DataFrame) -> DataFrame:
        """(x, y) of all records of these classes (a, na, b, nb), whose chunks are paired in tasks of their own."""

        def chunks(seen: bool, key: str, n: str, record: str) -> DataFrame:
            of = wide.select(key, n).distinct()
            rows = self.members.where(F.col("seen") == seen).select(F.col("key").alias(key), "record").join(of, key)
            part = F.pmod(F.xxhash64("record"), F.ceil(F.col(n) / CHUNK))
            return rows.groupBy(key, part.alias(f"part_{key}")).agg(F.collect_set("record").alias(record))

        blocks = wide.select("a", "b").join(chunks(True, "a", "na", "xs"), "a").join(chunks(False, "b", "nb", "ys"), "b")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = blocks.repartition(parts, "a", "b", "part_a", "part_b")
        return dealt.select(F.explode("xs").alias("x"), "ys").select("x", F.explode("ys").alias("y"))

    def membership(self) -> DataFrame:
        """(record, split, source, key) of every record that can make a case."""
        return self.members.select("record", "split", "source", "key")

    def by_split(self) -> DataFrame:
        """Per split and source the records, and how many of them overlap the training split."""
        hit = self.classes().select(F.col("b").alias("key"), (F.col("a") == F.col("b")).alias("same")).groupBy("key").agg(F.max("same").alias("same"))
        rows = self.members.where("not seen").select("record", "split", "source", "key").distinct().join(hit, "key", "left")
        overlapping = F.sum(F.col("same").isNotNull().cast("long"))
        return rows.groupBy("split", "source").agg(
            F.count("*").alias("n_records"), overlapping.alias("n_overlapping"), F.sum(F.coalesce(F.col("same"), F.lit(False)).cast("long")).alias("n_same"), F.round(overlapping / F.count("*"), 6).alias("share")
        )
