"""Phrase collocations: broadcast double-array tries of Apriori-safe candidates, walked by all text positions at once.

1. Texts become codes into chunk dictionaries in one reading; the dictionaries, summed, give the words of every language
   that occur ``LEAST`` times, and come back as word numbers. The corpus is then a table of number arrays, 0 for any word
   that no candidate can hold and for the end of a piece.
2. Level by level: positions whose phrase of k words is a candidate, and whose phrase shifted by one word is one too, are
   summed per task and then over tasks as phrases of k + 1 words; those with ``LEAST`` or more are candidates.
3. Candidates are dealt to tries of at most ``TRIE_PHRASES`` phrases, built in tasks. As many as ``ROUND_BYTES`` allow go
   out in one broadcast; beyond that there are several rounds, so neither bound depends on the corpus. numpy moves the
   states of all positions of a block down the tries together; accepting states are counted per task and summed by Spark.
4. Cuts, containment and ranks are joins on arrays of word numbers, in decimal arithmetic.

Cases: NULL texts are empty, NULL languages are ``und``; repeated rows count once each; ids may be NULL or repeated; a text
without words adds nothing; extra columns are not read; an empty table gives an empty report. Ties in a score are ordered
by count and then by the bytes of the phrase, so ranks are the same on every run.
"""

from __future__ import annotations

import zlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import query, stored, table, text_or_empty
from .chunks import pack, unpack

LEAST, LONGEST, TOP, CUT, CONTAINED = 30, 4, 2000, 2_000_000, 80
CHUNK_WORDS, CHUNK_BYTES, BLOCK, PIECE = 300_000, 24_000_000, 1 << 20, 1 << 18
TRIE_PHRASES, ROUND_BYTES, STRIDE = 200_000, 48 << 20, 1 << 17

#: Ends of pieces become \n, the other white space of the rule a blank.
_PIECES = bytes(10 if k in b".,;:!?\n\x0b\x0c\r" else 32 if k == 9 else k for k in range(256))


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased words of a text, with ``b"\\n"`` at every end of a piece."""
    return [w for w in text.lower().translate(_PIECES).replace(b"\n", b" \n ").split(b" ") if w]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that Python objects are made for these only."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


class Codes(dict):
    """word -> code of one language in a chunk; a new word takes the next number of the chunk's entries."""

    def __init__(self, lang: str, entries: list[tuple[str, bytes]]):
        super().__init__({b"\n": 0})
        self.lang, self.entries = lang, entries

    def __missing__(self, word: bytes) -> int:
        self.entries.append((self.lang, word))
        code = self[word] = len(self.entries)
        return code


def chunk_rows(docs: DataFrame) -> DataFrame:
    """Dictionary rows (chunk, code, lang, word, n) and code rows (chunk, at, codes) of every chunk, in one table.

    Code 0 ends a piece and a text; a chunk's dictionary is per language, with codes from 1.
    """
    names = ["chunk", "code", "lang", "word", "n", "at", "codes"]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]

    def rows(chunk, size, **columns):
        full = {"chunk": np.full(size, chunk), **columns}
        return pa.RecordBatch.from_arrays([pa.array(full[n], k) if n in full else pa.nulls(size, k) for n, k in zip(names, kinds)], names=names)

    def run(batches):
        task = TaskContext.get()
        chunk = (task.partitionId() if task else 0) << 24
        known: dict[str, Codes] = {}
        entries: list[tuple[str, bytes]] = []
        counts = np.zeros(1, np.int64)
        parts, held, seen, at = [], 0, 0, 0

        def piece():
            nonlocal parts, held, at, counts
            codes = np.concatenate(parts)
            if len(counts) <= len(entries):
                counts = np.append(counts, np.zeros(len(entries) + 1 + len(counts) // 2, np.int64))
            found = np.bincount(codes)
            counts[: len(found)] += found
            row = rows(chunk, 1, at=[at], codes=[zlib.compress(pack(codes), 1)])
            parts, held, at = [], 0, at + 1
            return row

        def dictionary():
            for k in range(0, len(entries), 50_000):
                some = entries[k : k + 50_000]
                yield rows(chunk, len(some), code=np.arange(k + 1, k + 1 + len(some), dtype=np.int32), lang=[x for x, _ in some], word=[x for _, x in some], n=counts[k + 1 : k + 1 + len(some)])

        for b in slices(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if lang not in known:
                    known[lang] = Codes(lang, entries)
                words = tokens(text)
                codes = np.zeros(len(words) + 1, np.int64)
                codes[:-1] = np.fromiter(map(known[lang].__getitem__, words), np.int64, len(words))
                parts.append(codes)
                held, seen = held + len(codes), seen + len(text)
                if held >= PIECE:
                    yield piece()
                if len(entries) >= CHUNK_WORDS or seen >= CHUNK_BYTES:
                    if parts:
                        yield piece()
                    yield from dictionary()
                    known, entries, counts, seen, at, chunk = {}, [], np.zeros(1, np.int64), 0, 0, chunk + 1
        if parts:
            yield piece()
        yield from dictionary()

    source = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), text_or_empty().cast("binary").alias("text"))
    return source.mapInArrow(run, "chunk long, code int, lang string, word binary, n long, at int, codes binary")


def numbered(rows: DataFrame) -> DataFrame:
    """Dense numbers from 1; one row per partition is sent out as the offsets."""
    laid = stored(rows.withColumn("gid", F.monotonically_increasing_id()))
    part = F.shiftright("gid", 33)
    before = laid.groupBy(part.alias("part")).agg(F.count("*").alias("size")).select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    number = F.col("before") + F.col("gid").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return laid.withColumn("part", part).join(F.broadcast(before), "part").withColumn("number", number.cast("int")).drop("gid", "part", "before")


def number_rows(chunked: DataFrame, words: DataFrame) -> DataFrame:
    """(ids): arrays of word numbers as int32 bytes, a block per row, in which 0 is a word that is not in ``words``."""
    codes = chunked.where("codes IS NOT NULL").select("chunk", "at", "codes")
    back = chunked.where("word IS NOT NULL").join(words.select("lang", "word", "number"), ["lang", "word"]).select(F.col("chunk").alias("of"), F.col("code").alias("place"), "number")

    def run(code_rows: pa.Table, found: pa.Table) -> pa.Table:
        code, number = found["place"].to_numpy(), found["number"].to_numpy()
        ids = np.zeros(int(code.max()) + 1 if len(code) else 1, np.int32)
        ids[code] = number
        out = []
        for data in code_rows["codes"].to_pylist():
            codes = unpack(zlib.decompress(data))
            out.append(zlib.compress(np.where(codes < len(ids), ids[np.minimum(codes, len(ids) - 1)], 0).astype("<i4").tobytes(), 1))
        return pa.table({"ids": pa.array(out, pa.binary())})

    return codes.groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(run, "ids binary")


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Word numbers of a task in blocks of about ``BLOCK``; every row ends with a 0, so that no phrase crosses its end."""
    parts, held = [], 0
    for b in slices(batches, 1):
        for data in b.column(0).to_pylist():
            ids = np.frombuffer(zlib.decompress(data), "<i4")
            parts.append(ids)
            held += len(ids)
            if held >= BLOCK:
                yield np.concatenate(parts)
                parts, held = [], 0
    if parts:
        yield np.concatenate(parts)


def strides(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
    """(first position, numbers, starts): ``STRIDE`` positions in turn, with the words that phrases from there reach.

    A task's memory follows from the stride, while what it sums up stays one block or the whole task.
    """
    for k in range(0, len(ids), STRIDE):
        some = ids[k : k + STRIDE + LONGEST - 1]
        yield k, some, min(STRIDE, len(ids) - k)


class Trie:
    """A double-array trie over word numbers: the child of state s by symbol c is t = base[s] + c if check[t] = s.

    ``symbols`` holds the numbers that occur, sorted; a number's symbol is its rank by frequency in the trie, so that the
    children of large nodes lie close together. State 0 is the root; ``accepts[t]`` is the length of the phrase that
    ends in t, or 0, and ``phrases[of[t]]`` its numbers.
    """

    KINDS = ("<i4", "<i4", "<i4", "<i4", "i1", "<i4", "<i4")

    def __init__(self, symbols, rank, base, check, accepts, of, phrases):
        self.symbols, self.rank, self.base, self.check, self.accepts, self.of = symbols, rank, base, check, accepts, of
        self.phrases = phrases.reshape(-1, LONGEST)

    @classmethod
    def of(cls, phrases: np.ndarray) -> "Trie":
        """``phrases``: rows of ``LONGEST`` numbers, shorter phrases filled up with 0."""
        symbols, place, often = np.unique(phrases[phrases > 0], return_inverse=True, return_counts=True)
        rank = np.empty(len(symbols), np.int32)
        rank[np.argsort(-often, kind="stable")] = np.arange(1, len(symbols) + 1)
        coded = np.zeros(phrases.shape, np.int32)
        coded[phrases > 0] = rank[place]
        size = 2 * len(symbols) + 4 * len(phrases) + 1024
        base, check, accepts = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.zeros(size, np.int8)
        state = np.zeros(len(phrases), np.int32)
        hint: dict[int, int] = {}
        check[0] = 0
        for level in range(LONGEST):
            live = np.flatnonzero(coded[:, level])
            if not len(live):
                break
            edges, own = np.unique((state[live].astype(np.int64) << 32) | coded[live, level], return_inverse=True)
            node, symbol = (edges >> 32).astype(np.int32), (edges & 0xFFFFFFFF).astype(np.int32)
            nodes, first, count = np.unique(node, return_index=True, return_counts=True)
            target = np.empty(len(edges), np.int32)
            many = np.flatnonzero(count > 1)
            for k in many[np.argsort(-count[many], kind="stable")]:
                c = symbol[first[k] : first[k] + count[k]]
                kind = int(count[k]).bit_length()
                at = hint.get(kind, 1)
                while True:
                    if at + 4096 + int(c[-1]) >= len(check):
                        base, check, accepts = (np.append(x, np.full(len(x), fill, x.dtype)) for x, fill in ((base, 0), (check, -1), (accepts, 0)))
                        continue
                    b = np.arange(at, at + 4096)
                    for x in c:
                        b = b[check[b + x] < 0]
                        if not len(b):
                            break
                    if len(b):
                        break
                    at += 4096
                hint[kind] = at
                base[nodes[k]] = b[0]
                check[b[0] + c] = nodes[k]
                target[first[k] : first[k] + count[k]] = b[0] + c
            single = np.flatnonzero(count == 1)
            if len(single):
                # a slot for an only child can be any free one; its base follows from the symbol and may be negative
                while (free := np.flatnonzero(check < 0)).size < len(single):
                    base, check, accepts = (np.append(x, np.full(len(x), fill, x.dtype)) for x, fill in ((base, 0), (check, -1), (accepts, 0)))
                slot = free[: len(single)].astype(np.int32)
                base[nodes[single]] = slot - symbol[first[single]]
                check[slot] = nodes[single]
                target[first[single]] = slot
            state[live] = target[own]
            ends = live[coded[live, level + 1] == 0] if level + 1 < LONGEST else live
            accepts[state[ends]] = level + 1
        used = int(np.flatnonzero(check >= 0)[-1]) + 1
        of = np.zeros(used, np.int32)
        of[state] = np.arange(len(phrases))
        return cls(symbols.astype(np.int32), rank, base[:used], check[:used], accepts[:used], of, phrases.astype(np.int32))

    def to_bytes(self) -> bytes:
        parts = (self.symbols, self.rank, self.base, self.check, self.accepts, self.of, self.phrases.ravel())
        return np.array([len(x) for x in parts], "<i8").tobytes() + b"".join(x.tobytes() for x in parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> "Trie":
        sizes, at, out = np.frombuffer(data, "<i8", len(cls.KINDS)), 8 * len(cls.KINDS), []
        for n, kind in zip(sizes, cls.KINDS):
            out.append(np.frombuffer(data, kind, int(n), at))
            at += int(n) * out[-1].itemsize
        return cls(*out)

    def ranks(self) -> np.ndarray:
        """Rank of every number up to the trie's last one, 0 for what it does not hold and for all beyond; made for one trie at a time."""
        out = np.zeros(int(self.symbols[-1]) + 2, np.int32)
        out[self.symbols] = self.rank
        return out

    def walk(self, ids: np.ndarray, starts: int | None = None, ranks: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(level, positions, states) for level 1, 2, ...: the positions whose next ``level`` words are a path of the trie.

        Only the first ``starts`` positions are set out from; what follows them may be read. ``ranks`` is the trie's own.
        """
        symbol = (self.ranks() if ranks is None else ranks).take(ids, mode="clip")
        at = np.flatnonzero(symbol[:starts])
        state = np.zeros(len(at), np.int32)
        for level in range(1, LONGEST + 1):
            inside = at + level - 1 < len(ids)
            at, state = at[inside], state[inside]
            c = symbol[at + level - 1]
            to = self.base[state] + c
            ok = (c > 0) & (to >= 0) & (to < len(self.check))
            at, state, to = at[ok], state[ok], to[ok]
            ok = self.check[to] == state
            at, state = at[ok], to[ok]
            if not len(at):
                return
            yield level, at, state


def tries_of(candidates: DataFrame) -> DataFrame:
    """(number, trie): candidates dealt by hash to tries of about ``TRIE_PHRASES`` phrases each, built in tasks."""
    n = -(-candidates.count() // TRIE_PHRASES)

    def run(group: pa.Table) -> pa.Table:
        phrases = np.zeros((group.num_rows, LONGEST), np.int32)
        flat = group["ids"].combine_chunks()
        sizes = np.diff(flat.offsets.to_numpy())
        row = np.repeat(np.arange(len(sizes)), sizes)
        phrases[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat.flatten().to_numpy()
        return pa.table({"number": pa.array([group["number"][0].as_py()], pa.int32()), "trie": pa.array([zlib.compress(Trie.of(phrases).to_bytes(), 1)], pa.binary())})

    dealt = candidates.select(F.pmod(F.xxhash64("ids"), F.lit(max(n, 1))).cast("int").alias("number"), "ids")
    return stored(dealt.groupBy("number").applyInArrow(run, "number int, trie binary"))


def rounds(tries: DataFrame):
    """Broadcasts of tries, each of at most ``ROUND_BYTES`` (or one trie); the sizes alone are looked at first."""
    spark = tries.sparkSession
    held, room, out = [], 0, []
    for number, size in tries.select("number", F.length("trie")).orderBy("number").collect():
        if held and room + size > ROUND_BYTES:
            out.append(held)
            held, room = [], 0
        held, room = [*held, number], room + size
    if held:
        out.append(held)
    for numbers in out:
        yield spark.sparkContext.broadcast([bytes(r.trie) for r in tries.where(F.col("number").isin(numbers)).orderBy("number").collect()]), len(out)


#: A phrase as two longs: the numbers of its words in turn, two to a long, 0 where it has none.
_GRAMS = "k1 long, k2 long, n long"


def _grams(words: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of ``LONGEST`` word numbers and their counts, as batches."""
    for k in range(0, len(words), 100_000):
        w = words[k : k + 100_000].astype(np.int64)
        columns = [(w[:, 0] << 32) | w[:, 1], (w[:, 2] << 32) | w[:, 3], n[k : k + 100_000].astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["k1", "k2", "n"])


def words_of_keys() -> Column:
    low = F.lit(0xFFFFFFFF)
    each = [F.shiftright("k1", 32), F.col("k1").bitwiseAND(low), F.shiftright("k2", 32), F.col("k2").bitwiseAND(low)]
    return F.filter(F.array(*[c.cast("int") for c in each]), lambda x: x > 0)


def pairs(numbers: DataFrame) -> DataFrame:
    """(k1, k2, n): pairs of frequent words that stand next to each other, summed per block."""

    def run(batches):
        for ids in blocks(batches):
            key = (ids[:-1].astype(np.int64) << 32) | ids[1:]
            key = key[(ids[:-1] > 0) & (ids[1:] > 0)]
            key.sort()
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
            n = np.diff(np.append(first, len(key)))
            key = key[first]
            for k in range(0, len(key), 100_000):
                some = key[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.zeros(len(some), np.int64)), pa.array(n[k : k + 100_000])], names=["k1", "k2", "n"])

    return numbers.mapInArrow(run, _GRAMS)


def longer(numbers: DataFrame, tries: DataFrame, size: int) -> DataFrame:
    """(k1, k2, n): phrases of ``size`` words whose parts of ``size - 1`` words are candidates, summed per block.

    With one round both parts are asked for; with several the second may be in another round, and only the first is.
    """
    out = None
    for sent, n_rounds in rounds(tries):

        def run(batches, sent=sent, both=n_rounds == 1):
            held = [Trie.from_bytes(zlib.decompress(x)) for x in sent.value]
            offset = np.cumsum([0, *[len(t.check) for t in held]])
            for ids in blocks(batches):
                state = np.full(len(ids) + 1, -1, np.int32)
                for k, t in enumerate(held):
                    ranks = t.ranks()
                    for first, some, starts in strides(ids):
                        for level, at, to in t.walk(some, starts, ranks):
                            if level == size - 1:
                                whole = t.accepts[to] == level
                                state[first + at[whole]] = to[whole] + offset[k]
                at = np.flatnonzero((state[:-1] >= 0) & ((state[1:] >= 0) | (not both)))
                at = at[at + size <= len(ids)]
                at = at[ids[at + size - 1] > 0]
                _, first, n = np.unique((state[at].astype(np.int64) << 32) | ids[at + size - 1], return_index=True, return_counts=True)
                at = at[first]
                for k in range(0, len(at), 100_000):
                    words = np.zeros((len(at[k : k + 100_000]), LONGEST), np.int32)
                    words[:, :size] = ids[at[k : k + 100_000, None] + np.arange(size)]
                    yield from _grams(words, n[k : k + 100_000])

        found = numbers.mapInArrow(run, _GRAMS)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else numbers.sparkSession.createDataFrame([], _GRAMS)


def counted(numbers: DataFrame, tries: DataFrame) -> DataFrame:
    """(ids, a): every candidate's number of occurrences; each task counts accepting states, Spark sums the tasks."""
    out = None
    for sent, _ in rounds(tries):

        def run(batches, sent=sent):
            held = [Trie.from_bytes(zlib.decompress(x)) for x in sent.value]
            # a count for each phrase, not for each state of the tries
            total = [np.zeros(len(t.phrases), np.int64) for t in held]
            for ids in blocks(batches):
                for k, t in enumerate(held):
                    ranks = t.ranks()
                    for _, some, starts in strides(ids):
                        ends = [t.of[to[t.accepts[to] > 0]] for _, _, to in t.walk(some, starts, ranks)]
                        if ends:
                            total[k] += np.bincount(np.concatenate(ends), minlength=len(t.phrases))
            for k, t in enumerate(held):
                own = np.flatnonzero(total[k])
                yield from _grams(t.phrases[own], total[k][own])

        found = numbers.mapInArrow(run, _GRAMS)
        out = found if out is None else out.unionByName(found)
    out = out if out is not None else numbers.sparkSession.createDataFrame([], _GRAMS)
    return out.groupBy("k1", "k2").agg(F.sum("n").alias("a")).select(words_of_keys().alias("ids"), "a")


def phrase_counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, candidates, totals): frequent words (lang, word, number, f), phrases (ids, a), words of each language."""
    chunked = stored(chunk_rows(docs))
    tally = stored(chunked.where("word IS NOT NULL").groupBy("lang", "word").agg(F.sum("n").alias("f")))
    totals = tally.groupBy("lang").agg(F.sum("f").alias("n"))
    words = stored(numbered(tally.where(F.col("f") >= least)))
    numbers = stored(number_rows(chunked, words))

    def frequent(grams: DataFrame) -> DataFrame:
        return stored(grams.groupBy("k1", "k2").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select(words_of_keys().alias("ids")))

    level = candidates = frequent(pairs(numbers))
    for size in range(3, LONGEST + 1):
        level = frequent(longer(numbers, tries_of(level), size))
        candidates = candidates.unionByName(level)
    return words, stored(counted(numbers, tries_of(stored(candidates)))), totals


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best ``top`` phrases of every language."""
    words, found, totals = phrase_counts(docs, least)
    f = found.select("ids", "a").unionByName(words.select(F.array("number").alias("ids"), F.col("f").alias("a")))
    cuts = found.select("ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("ids", F.lit(1), F.col("k")), "right": F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k"))})
    cuts = cuts.join(f.select(F.col("ids").alias("left"), F.col("a").alias("l")), "left").join(f.select(F.col("ids").alias("right"), F.col("a").alias("r")), "right")
    cuts = cuts.withColumn("score", F.expr(f"(CAST({CUT} AS DECIMAL(38,0)) * CAST(a AS DECIMAL(19,0))) div CAST(l + r AS DECIMAL(38,0))").cast("long"))
    scored = cuts.groupBy("ids").agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    size, span = F.size("ids"), F.col("span")
    inner = found.where(size > 2).select("ids", "a", F.explode(F.sequence(F.lit(2), size - 1)).alias("span"))
    inner = inner.select(F.explode(F.transform(F.sequence(F.lit(1), size - span + 1), lambda at: F.slice("ids", at, span))).alias("ids"), "a")
    inner = inner.groupBy("ids").agg(F.max("a").alias("over"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    left = scored.join(inner, "ids", "left").where(F.col("over").isNull() | (100 * wide("over") < CONTAINED * wide("a"))).drop("over")

    spelled = left.select("ids", F.posexplode("ids").alias("at", "number")).join(words.select("number", "lang", "word"), "number")
    spelled = spelled.groupBy("ids").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("word").cast("string").alias("word")))), lambda x: x["word"]), " ").alias("phrase"))
    left = left.join(spelled, "ids")
    order = [F.col("cut.score").desc(), F.col("a").desc(), F.col("phrase")]
    # the best of every share first, so that the last window gets a bounded number of rows of each language
    share = F.pmod(F.xxhash64("phrase"), F.lit(64))
    near = left.withColumn("share", share).withColumn("place", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("place") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


ORACLE_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
pieces AS (
  SELECT id, lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece,
         generate_subscripts(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]'), 1) AS p
  FROM docs),
lists AS (
  SELECT id, lang, p, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS ws FROM pieces),
places AS (SELECT id, lang, p, ws, generate_subscripts(ws, 1) AS i FROM lists WHERE len(ws) > 0),
totals AS (SELECT lang, count(*) AS n FROM places GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM places, (VALUES (1), (2), (3), (4)) t(k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, k, g, string_split(g, ' ') AS ws, count(*) AS a FROM grams GROUP BY lang, k, g HAVING count(*) >= 30),
cand AS (SELECT * FROM f WHERE k >= 2),
cuts AS (
  SELECT c.lang, c.g, c.k, c.a, cut, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a // (l.a + r.a))::BIGINT AS score
  FROM cand c, (VALUES (1), (2), (3)) t(cut), f l, f r
  WHERE cut < c.k AND l.lang = c.lang AND l.g = array_to_string(c.ws[1:cut], ' ')
    AND r.lang = c.lang AND r.g = array_to_string(c.ws[cut + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
subs AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS g, max(a) AS a
  FROM cand, (VALUES (1), (2), (3)) s(i), (VALUES (2), (3)) t(m)
  WHERE m < cand.k AND i + m - 1 <= cand.k GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN subs s ON s.lang = b.lang AND s.g = b.g
  WHERE s.a IS NULL OR 100::HUGEINT * s.a < 80::HUGEINT * b.a),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, score
  FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query("op13_phrase_collocations", ORACLE_SQL)
def op13_phrase_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))
