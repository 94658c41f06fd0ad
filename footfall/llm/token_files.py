"""Token ids in Arrow files of equal-length sequences.

``write_token_files`` encodes whole texts in ascending doc_id order, appends the end id to each, and packs the stream of
ids into sequences of ``SEQUENCE`` ids. A file is in Arrow's IPC file format; its record batches hold fixed-size lists
``ids`` and ``mask`` (whether a place holds an id; the rest of a file's last sequence is padding), uncompressed, so that
a memory-mapped file gives any sequence without a copy. A second Arrow file beside it says where each document starts.
Ids are unsigned 16-bit where the vocabulary allows, else 32-bit.

Encoding: white space separates the words of this tokenizer and is dropped, so a text's ids are those of its pieces
between blanks in turn. Arrow cuts a batch into pieces; each distinct one goes through the tokenizers library unless
bounded tables, which let go of what was asked for longest ago, still have its ids or those of its words.

Tasks write files of their own name and report them, and only reported files are read: see ``warc``.

Defined results: a null or empty text has the end id alone; rows of one doc_id follow each other in the order of their
texts; a null doc_id comes first; an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footfall.llm._common import documents, new_path, text_batches, tidy, written

SEQUENCE = 2048
END_ID = 2
BATCH = 4 << 20
KNOWN_PIECES = 500_000
#: Sequences in a record batch.
BATCH_ROWS = 256


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: How this tokenizer cuts lower-case text into words, as its own file says. Fixed values.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Up to here, characters have one case mapping and one composed form in every version of Unicode.
PLAIN = 0x250


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(prints)]
    return [chr(b) if b in set(prints) else chr(256 + others.index(b)) for b in range(256)]


class Seen:
    """Ids of strings seen before, ``most`` of them: once half are new, those not asked for since the last time go."""

    def __init__(self, most: int):
        self.half = most // 2
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, key: str) -> bytes | None:
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.new[key] = found
        return found

    def add(self, key: str, ids: bytes) -> bytes:
        self.new[key] = ids
        return ids

    def make_room(self, n: int) -> None:
        """Let ``n`` strings that are added next stay together."""
        if len(self.new) + n > self.half:
            self.old, self.new = self.new, {}


class WordEncoder:
    """Ids of whole texts as little-endian bytes, for tokenizers that drop white space between words.

    A piece between blanks that was not seen before is cut into words by the tokenizer's own pattern and its model
    encodes each new word; a piece with characters beyond the plain ones, or that may hold a special token, goes through
    the whole tokenizer instead.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.known, self.words = Seen(KNOWN_PIECES), Seen(KNOWN_PIECES)
        self.find = regex.compile(WORD_PATTERN).findall
        self.letters = dict(enumerate(_byte_letters()))

    def word(self, word: str) -> bytes:
        spelt = word.encode("utf-8").decode("latin-1").translate(self.letters)
        return self.packed([t.id for t in self.tokenizer.model.tokenize(spelt)])

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.dtype.char}", *ids)

    def learn(self, fresh: list[str]) -> None:
        add, words, find, hard = self.known.add, self.words, self.find, []
        for piece in fresh:
            if (piece.isascii() or max(piece) < chr(PLAIN)) and "<|" not in piece:
                lower, ids = piece.lower(), []
                for w in (lower,) if lower.isalpha() else find(lower):
                    found = words.get(w)
                    ids.append(words.add(w, self.word(w)) if found is None else found)
                add(piece, b"".join(ids))
            else:
                hard.append(piece)
        for at in range(0, len(hard), 4096):
            part = hard[at : at + 4096]
            for piece, found in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
                add(piece, self.packed(found.ids))

    def encode(self, texts) -> list[bytes]:
        """The ids of each text of an Arrow array, or of a list.

        Arrow cuts the texts and numbers their distinct pieces; only these are looked up, and taken by number.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        plain = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        for blank in "\n\t":
            plain = pc.replace_substring(plain, blank, " ")
        cut = pc.split_pattern(plain, " ")
        pieces = cut.flatten().dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        self.known.make_room(len(distinct))
        self.words.make_room(len(distinct))
        get = self.known.get
        found = [get(p) for p in distinct]
        fresh = [i for i, ids in enumerate(found) if ids is None]
        self.learn([distinct[i] for i in fresh])
        for i in fresh:
            found[i] = get(distinct[i])
        taken = pa.array(found, pa.large_binary()).take(pieces.indices)
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(cut).to_numpy())])
        at = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset + ends]
        data = memoryview(taken.buffers()[2] or b"")
        return [bytes(data[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]


@functools.cache
def encoder_of(path: str) -> WordEncoder:
    """One for each Python worker, which serves many tasks."""
    return WordEncoder(path)


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_token_files(
    docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, length: int = SEQUENCE
) -> DataFrame:
    """Encode doc_id and text in ascending doc_id order; path, first_doc, documents and ids of each file."""
    import pyarrow as pa

    def write(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = encoder_of(tokenizer_path)
        kind = pa.from_numpy_dtype(encoder.dtype)
        schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        end = np.array([end_id], encoder.dtype).tobytes()
        system, base = _file_system(folder)
        system.create_dir(base, recursive=True)
        name, writer, sink = f"part-{uuid.uuid4().hex}", None, None
        held, held_bytes, index, total, first = [], 0, [], 0, None
        whole = BATCH_ROWS * length * encoder.dtype.itemsize

        def put(data: bytes, real: int):
            ids = pa.array(np.frombuffer(data, encoder.dtype))
            mask = np.zeros(len(ids), bool)
            mask[:real] = True
            writer.write_batch(
                pa.RecordBatch.from_arrays(
                    [
                        pa.FixedSizeListArray.from_arrays(ids, length),
                        pa.FixedSizeListArray.from_arrays(pa.array(mask), length),
                    ],
                    schema=schema,
                )
            )

        for batch in text_batches(batches, limit=BATCH):
            if writer is None:
                sink = system.open_output_stream(f"{base}/{name}.arrow", compression=None)
                writer = pa.ipc.new_file(sink, schema)
                first = batch.column("doc_id")[0].as_py()
            ids = [x + end for x in encoder.encode(batch.column("text"))]
            lengths = np.array([len(x) for x in ids]) // encoder.dtype.itemsize
            index.append((batch.column("doc_id"), total + np.cumsum(lengths) - lengths, lengths))
            total += int(lengths.sum())
            held += ids
            held_bytes += sum(map(len, ids))
            if held_bytes >= whole:
                data = b"".join(held)
                for at in range(0, len(data) - whole + 1, whole):
                    put(data[at : at + whole], BATCH_ROWS * length)
                rest = data[len(data) // whole * whole :]
                held, held_bytes = [rest], len(rest)
        if writer is None:
            return
        data = b"".join(held)
        if data:
            real = len(data) // encoder.dtype.itemsize
            put(data + bytes(-len(data) % (length * encoder.dtype.itemsize)), real)
        writer.close()
        sink.close()
        table = pa.table(
            {
                "doc_id": pa.chunked_array([d for d, _, _ in index]),
                "start": np.concatenate([s for _, s, _ in index]).astype(np.int64),
                "n_tokens": np.concatenate([n for _, _, n in index]).astype(np.int64),
            }
        )
        with system.open_output_stream(f"{base}/{name}.index.arrow", compression=None) as out:
            with pa.ipc.new_file(out, table.schema) as index_writer:
                index_writer.write_table(table)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([f"{folder}/{name}"]),
                pa.array([first], pa.int64()),
                pa.array([table.num_rows], pa.int64()),
                pa.array([total], pa.int64()),
            ],
            names=["path", "first_doc", "documents", "ids"],
        )

    ordered = docs.select(F.col("doc_id").cast("bigint"), "text")
    parts = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ordered = ordered.repartitionByRange(int(parts), "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(tidy(write), "path string, first_doc bigint, documents bigint, ids bigint")


def open_sequences(path: str):
    """(ids, mask) of a token file on a local disk, memory-mapped: n x length arrays of each record batch, not copied."""
    import pyarrow as pa

    reader = pa.ipc.open_file(pa.memory_map(path))
    for i in range(reader.num_record_batches):
        batch = reader.get_batch(i)
        ids, mask = batch.column("ids"), batch.column("mask")
        yield ids.flatten().to_numpy().reshape(len(batch), -1), mask


def read_documents(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files (path, first_doc, documents, ids)."""
    import pyarrow as pa

    order = Window.orderBy(F.col("first_doc").asc_nulls_first(), "path").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("base", F.coalesce(F.sum("ids").over(order), F.lit(0)))

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                system, at = _file_system(path)
                with system.open_input_file(f"{at}.index.arrow") as source:
                    index = pa.ipc.open_file(source).read_all()
                starts, counts = index.column("start").to_numpy(), index.column("n_tokens").to_numpy()
                sums = np.zeros(len(starts), np.int64)
                with system.open_input_file(f"{at}.arrow") as source:
                    reader = pa.ipc.open_file(source)
                    low, doc, crc = 0, 0, 0
                    for i in range(reader.num_record_batches):
                        block = reader.get_batch(i)
                        mask = block.column("mask").flatten().to_numpy(zero_copy_only=False)
                        ids = block.column("ids").flatten().to_numpy()[: int(mask.sum())].astype("<u4")
                        while doc < len(starts) and starts[doc] < low + len(ids):
                            a, b = max(0, starts[doc] - low), starts[doc] + counts[doc] - low
                            crc = zlib.crc32(ids[a : min(b, len(ids))], crc)
                            if b > len(ids):
                                break
                            sums[doc], crc, doc = crc, 0, doc + 1
                        low += len(ids)
                    if doc != len(starts):
                        raise EOFError(f"{path} ends inside a document")
                for part in range(0, len(starts), 20_000):
                    cut = slice(part, part + 20_000)
                    yield pa.RecordBatch.from_arrays(
                        [
                            index.column("doc_id").combine_chunks()[cut],
                            pa.array(starts[cut] + base),
                            pa.array(counts[cut]),
                            pa.array(sums[cut]),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    n = max(1, files.count())
    return placed.repartition(n, "path").mapInArrow(
        tidy(read), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def token_files(spark: SparkSession, docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Write docs to token files in the shared folder; the table of files."""
    folder = new_path(spark, "tokens")
    return written(write_token_files(docs, folder, tokenizer_path or vocabulary()), "token-files")


def tokens_query(spark, sf_dir: str) -> DataFrame:
    return read_documents(token_files(spark, documents(spark, sf_dir)))
