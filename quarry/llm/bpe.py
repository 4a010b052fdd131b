"""Operator 1: BPE encoding and decoding with a distinct-word table.

1. Texts are split into words (the pieces of ``vocab.cut``); each task counts its distinct words, a shuffle makes the
   table of all distinct words, and each is encoded once.
2. The ``hot_words`` most frequent words, a fixed bound, are sent to all tasks; a text becomes the list of their numbers
   with holes at other words. A frequent word therefore never is a join key.
3. The words in the holes, the rare tail, join the table by word and return to their text by key and position. A word
   that is frequent but too long for the table of step 2 is salted.
4. Ids are put together for each text and joined to the tokenizer's id-to-piece table, which is as long as the
   vocabulary and hence held by each task, to give the decoded text.

All texts are covered; the bound only says which of two ways a word takes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.arrow import pieces, release
from quarry.llm.store import materialise
from quarry.llm.words import _LOWER, SLICE, _buffers, span_hashes

LONGEST_HOT = 64
HOT_WORDS = 1 << 18
_U = np.uint64
_tables: dict[str, HotTable] = {}


def hash_words(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The pair of hashes that ``vocab.cut`` gives a piece, for each word of a column."""
    offsets, data = _buffers(words)
    return span_hashes(data, offsets[:-1], offsets[1:])


def split_words(column: pa.Array) -> Iterator[tuple[tuple[np.ndarray, np.ndarray], np.ndarray, bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a text column: pairs of word hashes, first word of each text, and the buffer with starts and ends of words.
    A text that the tokenizer must see whole (special tokens, combining marks) is one word."""
    from quarry.llm.vocab import cut

    offsets, data = _buffers(column)
    n, d = len(offsets) - 1, 0
    while d < n:
        e = max(d + 1, int(np.searchsorted(offsets, offsets[d] + SLICE, side="right")) - 1)
        raw, at = data[offsets[d] : offsets[e]], offsets[d : e + 1] - offsets[d]
        d = e
        apart = (raw == 0xCC) | (raw == 0xCD)
        apart[:-1] |= (raw[:-1] == ord("<")) & (raw[1:] == ord("|"))
        whole = np.unique(np.searchsorted(at, np.flatnonzero(apart), side="right") - 1)
        low = _LOWER[raw]
        for i in whole:
            low[at[i] : at[i + 1]] = raw[at[i] : at[i + 1]]
        none = np.zeros(0, np.int64)
        keys, starts, ends, first = cut(low, at) if len(low) else ((none.astype(_U), none.astype(_U)), none, none, np.zeros(len(at), np.int64))
        if len(whole):
            keep = np.ones(len(starts), dtype=bool)
            for i in whole:
                keep[first[i] + 1 : first[i + 1]] = False
                starts[first[i]], ends[first[i]] = at[i], at[i + 1]
                for key, x in zip(keys, span_hashes(low, at[i : i + 1], at[i + 1 : i + 2]), strict=True):
                    key[first[i]] = x[0]
            first = np.concatenate([[0], np.cumsum(keep)])[first]
            keys, starts, ends = (keys[0][keep], keys[1][keep]), starts[keep], ends[keep]
        yield keys, first, low.tobytes(), starts, ends, at


def count_words(docs: DataFrame, text_col: str, bits: int = 18) -> DataFrame:
    """``word, n`` of all texts, counted in each task before the shuffle. When a task's table of ``2 ** (bits - 1)`` words
    is full, its less frequent three quarters are emitted and leave; Spark's partial sums then merge what it emitted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quarry.llm.vocab import Table, distinct

        table, counts, words = Table(bits), np.zeros(1 << (bits - 1), np.int64), []

        def rows(which: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(which), 50_000):
                some = which[k : k + 50_000]
                yield pa.RecordBatch.from_pydict({"word": pa.array([words[i] for i in some.tolist()], pa.binary()), "n": pa.array(counts[some])})

        for batch in batches:
            for part in pieces(batch, "text"):
                for keys, _, text, starts, ends, _ in split_words(part.column("text")):
                    entry, where = table.find(keys), np.zeros(0, np.int64)
                    if (entry < 0).any():
                        where = np.flatnonzero(entry < 0)
                        where = where[distinct((keys[0][where], keys[1][where]))]
                        if table.room // 2 >= len(where) > table.room - table.size:
                            order = np.argsort(-counts[: table.size], kind="stable")
                            stay = order[: table.room // 4]
                            yield from rows(order[table.room // 4 :])
                            words, held = [words[i] for i in stay.tolist()], counts[stay]
                            counts[:] = 0
                            counts[: len(stay)] = held
                            table = Table(bits)
                            table.add(hash_words(pa.array(words, pa.binary())))
                            entry = table.find(keys)
                            where = np.flatnonzero(entry < 0)
                            where = where[distinct((keys[0][where], keys[1][where]))]
                    if len(where) <= table.room - table.size:
                        table.add((keys[0][where], keys[1][where]))
                        words += [text[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
                        entry = table.find(keys)
                    else:  # a text with very many words of its own: they are emitted without the table
                        at = np.flatnonzero(entry < 0)
                        found = pa.table({"word": pa.array([text[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], pa.binary())})
                        found = found.group_by("word").aggregate([([], "count_all")])
                        yield pa.RecordBatch.from_pydict({"word": found["word"].combine_chunks(), "n": found["count_all"].combine_chunks()})
                        entry = entry[entry >= 0]
                    counts[: table.size] += np.bincount(entry, minlength=table.size)
        yield from rows(np.arange(table.size))
        del table, words
        release()

    counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def piece_names(tokenizer: str) -> list[bytes]:
    """The id-to-piece table of a tokenizer file."""
    from quarry.llm.vocab import load

    vocab = load(tokenizer).get_vocab(with_added_tokens=True)
    out = [b""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        out[i] = piece.encode()
    return out


def piece_table(spark: SparkSession, tokenizer: str) -> DataFrame:
    """The same table as rows ``id, piece``."""
    names = piece_names(tokenizer)
    return spark.createDataFrame(pa.table({"id": pa.array(range(len(names)), pa.int32()), "piece": pa.array([x.decode() for x in names])}))


def decode(coded: DataFrame, tokenizer: str, key: str, ids_col: str = "ids") -> DataFrame:
    """``key, decoded`` for rows of ``ids``: an id-to-piece join, pieces joined by one blank in their order. Rows
    without ids decode to an empty text; unknown ids are left out. ``key`` must be distinct."""
    table = F.broadcast(piece_table(coded.sparkSession, tokenizer))
    each = coded.select(key, F.posexplode_outer(ids_col).alias("pos", "id")).join(table, "id", "left")
    held = each.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", "piece")))).alias("p"))
    return held.select(key, F.array_join(F.col("p.piece"), " ").alias("decoded"))


def encode_words(words: DataFrame, tokenizer: str) -> DataFrame:
    """``word, n, ids`` of distinct words, each encoded once; ids as little-endian bytes of the encoder's width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quarry.llm.vocab import Encoder

        encoder = Encoder(tokenizer)  # freed with the task, as later stages need the room
        for batch in batches:
            ids = encoder.pieces(batch.column("word").to_pylist())
            yield pa.RecordBatch.from_pydict({"word": batch.column("word"), "n": batch.column("n"), "ids": pa.array([x.tobytes() for x in ids], pa.binary())})
            release()

    return words.mapInArrow(run, "word binary, n long, ids binary")


def id_bytes(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of id bytes in a row, and how many each value holds."""
    offsets, data = _buffers(column)
    flat = np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), dtype=f"<u{width}") if len(offsets) > 1 else np.zeros(0, np.uint32)
    return flat.astype(np.int32), np.diff(offsets) // width


def pieces_of(flat: np.ndarray, sizes: np.ndarray, names: list[bytes]) -> list[bytes]:
    """The decoded bytes of each group of ids: its pieces, looked up by id, each followed by a blank."""
    found, ends = [names[i] for i in flat.tolist()], np.cumsum(sizes).tolist()
    return [b"".join(found[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


class HotTable:
    """The frequent words' numbers, ids and decoded bytes in a Python worker; the last table used is kept."""

    def __init__(self, data: bytes, names: list[bytes], width: int, heavy: tuple[np.ndarray, np.ndarray, np.ndarray]):
        from quarry.llm.vocab import Table

        rows = pa.ipc.open_stream(data).read_all().combine_chunks()
        self.names, self.width = [x + b" " for x in names], width
        self.ids, self.sizes = id_bytes(rows["ids"], width)
        self.table = Table(max(8, (2 * rows.num_rows).bit_length() + 1))
        self.table.add(hash_words(rows["word"]))
        self._texts = None
        self.heavy = Table(max(8, (2 * len(heavy[0])).bit_length() + 1))
        self.heavy.add(heavy[:2])
        self.ways = heavy[2]

    @classmethod
    def of(cls, name: str, data: tuple) -> HotTable:
        if name not in _tables:
            _tables.clear()
            _tables[name] = cls(*data)
        return _tables[name]

    def salts(self, keys: tuple[np.ndarray, np.ndarray], own: np.ndarray) -> np.ndarray:
        """For words without a number the part, by a hash ``own``, of a heavy word's rows; 0 for other words."""
        at = self.heavy.find(keys)
        return np.where(at >= 0, own.view(_U) % np.append(self.ways, 1)[at], 0).astype(np.int32)

    @property
    def texts(self) -> list[bytes]:
        if self._texts is None:
            self._texts = pieces_of(self.ids, self.sizes, self.names)
        return self._texts


def squeezed(numbers: np.ndarray) -> bytes:
    """Word numbers (-1 for a hole) as three planes of bytes; frequent words have small numbers."""
    return (numbers + 1).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes()


def unsqueezed(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(3, -1).astype(np.int64)
    return planes[0] + (planes[1] << 8) + (planes[2] << 16) - 1


def _hot(table: DataFrame, most: int, share: int = 1 << 16) -> tuple[bytes, tuple[np.ndarray, ...], DataFrame]:
    """The most frequent words, at most ``most``, as an Arrow stream; hashes and ways of the heavy words, which are too
    long for that table and stand ``share`` times or more (or in a ``share``-th of all places, so that they are at most
    ``share``); and the rest of ``table`` with a row for each ``salt`` of a word."""
    level = F.when(F.length("word") <= LONGEST_HOT, F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")).otherwise(-1)
    levels = table.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("n")).collect()  # a few hundred at most
    cut, held = 1 << 30, 0
    for r in sorted(levels, key=lambda r: -r["level"]):
        if r["level"] < 0 or held + r["count"] > most:
            break
        cut, held = r["level"], held + r["count"]
    found = table.filter(level >= cut).toArrow().sort_by([("n", "descending"), ("word", "ascending")]).select(["word", "ids"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, found.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(found.combine_chunks())
    part = max(share, sum(r["n"] for r in levels) // share)
    rest = table.filter(level < cut)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = hash_words(batch.column("word"))
            yield pa.RecordBatch.from_pydict({"one": pa.array(one.view(np.int64)), "two": pa.array(two.view(np.int64)), "n": batch.column("n")})

    many = rest.filter(F.col("n") >= part).select("word", "n").mapInArrow(hashed, "one long, two long, n long").toArrow()
    column = lambda c: np.asarray(many[c], dtype=np.int64)
    ways = F.when(F.col("n") >= part, F.floor(F.col("n") / part) + 1).otherwise(F.lit(1)).cast("int")
    salted = rest.withColumn("salt", F.explode(F.sequence(F.lit(0), ways - 1)))
    return sink.getvalue().to_pybytes(), (column("one").view(_U), column("two").view(_U), (column("n") // part + 1).astype(_U)), salted


def bpe(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", hot_words: int = HOT_WORDS) -> DataFrame:
    """One row for each input row: ``doc_id, ids, decoded``.

    Ids are those of the tokenizers library without added special tokens; ``decoded`` is its decoding of them, special
    tokens included. Null text is empty and has no ids. Repeated rows repeat, null ids are kept, empty input gives an
    empty result and further columns are not read.
    """
    spark = docs.sparkSession
    table = materialise(encode_words(count_words(docs, text_col), tokenizer), "word-table")
    data, heavy, rare = _hot(table, hot_words)
    names = piece_names(tokenizer)
    width = 2 if len(names) <= 65536 else 4
    name, hot = uuid.uuid4().hex, spark.sparkContext.broadcast((data, names, width, heavy))

    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumns(
        {"k1": F.xxhash64("doc_id", "text"), "k2": F.hash(F.lit(7), "text", "doc_id")}  # 96 bits
    )

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        known, squeeze = HotTable.of(name, hot.value), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in pieces(batch, "text"):
                out = []
                for keys, first, *_ in split_words(part.column("text")):
                    entry = known.table.find(keys)
                    out += [squeeze.compress(squeezed(entry[a:b])) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({**{c: part.column(c) for c in ("doc_id", "k1", "k2")}, "numbers": pa.array(out, pa.binary())})

    def holes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = HotTable.of(name, hot.value)
        for batch in batches:
            for part in pieces(batch, "text"):
                row, k1, k2 = 0, np.asarray(part.column("k1"), dtype=np.int64), np.asarray(part.column("k2"), dtype=np.int32)
                for keys, first, text, starts, ends, _ in split_words(part.column("text")):
                    at = np.flatnonzero(known.table.find(keys) < 0)
                    doc = np.searchsorted(first, at, side="right") - 1
                    salt = known.salts((keys[0][at], keys[1][at]), k1[row + doc] + at - first[doc])
                    yield pa.RecordBatch.from_pydict(
                        {
                            "k1": pa.array(k1[row + doc]), "k2": pa.array(k2[row + doc]), "pos": pa.array(at - first[doc], pa.int32()), "salt": pa.array(salt),
                            "word": pa.array([text[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], pa.binary()),
                        }
                    )
                    row += len(first) - 1

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        from quarry.llm.vocab import spread

        known, open_ = HotTable.of(name, hot.value), zstandard.ZstdDecompressor()
        flat, sizes, texts = known.ids, known.sizes, known.texts
        starts = np.cumsum(sizes) - sizes
        for batch in batches:
            for part in pieces(batch, "numbers", 1 << 18):
                entries = [unsqueezed(open_.decompress(z)) for z in part.column("numbers").to_pylist()]
                edges = np.concatenate([[0], np.cumsum([len(e) for e in entries], dtype=np.int64)])
                entry = np.concatenate(entries)
                rest = part.column("rest")
                owner = np.repeat(np.arange(len(rest)), np.diff(np.asarray(rest.offsets, dtype=np.int64)))
                tail = rest.flatten()
                at = edges[owner] + np.asarray(tail.field("pos"), dtype=np.int64)
                if not np.array_equal(np.sort(at), np.flatnonzero(entry < 0)):
                    raise RuntimeError("the words found do not fill the places left open in their texts")
                own, own_sizes = id_bytes(tail.field("ids"), width)
                entry[at] = len(sizes) + np.arange(len(at))
                ids_of = np.concatenate([flat, own])
                size_of = np.concatenate([sizes, own_sizes])[entry]
                start_of = np.concatenate([starts, len(flat) + np.cumsum(own_sizes) - own_sizes])[entry]
                words = pieces_of(own, own_sizes, known.names)
                n, listed = len(texts), entry.tolist()
                said = [texts[e] if e < n else words[e - n] for e in listed]
                decoded = [b"".join(said[a:b])[:-1] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                ends = np.concatenate([[0], np.cumsum(size_of)])[edges]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids_of[spread(start_of, size_of)], pa.int32())),
                        "decoded": pa.array(decoded, pa.binary()).cast(pa.string()),
                    }
                )

    found = keyed.select("k1", "k2", "text").mapInArrow(holes, "k1 long, k2 int, pos int, salt int, word binary")
    found = found.join(rare.select("word", "salt", "ids"), ["word", "salt"])
    found = found.groupBy("k1", "k2").agg(F.collect_set(F.struct("pos", "ids")).alias("rest"))
    rows = keyed.mapInArrow(numbers, "doc_id long, k1 long, k2 int, numbers binary").join(found, ["k1", "k2"], "left")
    nothing = F.array().cast("array<struct<pos:int,ids:binary>>")
    rows = rows.select("doc_id", "numbers", F.coalesce("rest", nothing).alias("rest"))
    return rows.mapInArrow(assemble, "doc_id long, ids array<int>, decoded string")


def digests(coded: DataFrame) -> DataFrame:
    """Counts and digests of ``bpe``'s output."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
