"""SentencePiece ids by a Viterbi pass that words with common prefixes share, and the way back.

Texts are normalised as the model says (a blank put first, blanks written as U+2581), and cut into marked words: blanks
and what follows them. No piece of such a model reaches over a word's end, so words are encoded alone. The distinct
words of a batch are sorted; in that order they are the leaves of a trie, visited depth-first: the forward table of the
common prefix with the word before is kept, and only the rest of the word is computed.

The forward table depends on the kind of model. For a unigram model a cell holds the best score of a segmentation of the
prefix and its last piece. The scores of a BPE model only order its merges, and the best sum of them is not what
the model's encoder gives; there a cell holds the last piece of the prefix's BPE encoding, which is the one piece that ends
there and is compatible with the cell where it starts: two pieces are compatible if merging their joint text by rank
leaves the two. Either way, a cell depends on its prefix alone, which is what makes sharing right.

Characters that no piece has are spelt as byte pieces. ``decode`` joins pieces and bytes, and drops the blank put first.

Defined results: a null or empty text has no ids; decoding gives the normalised text (U+2581 itself becomes a blank);
repeated rows give repeated results; an empty table gives no rows; other columns pass through ``encode_column``'s
``keep_columns`` and are ignored by the query. Text of any length is one word list; a single word of any length, such as
text without blanks, is encoded in time and memory in proportion to it.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm._common import documents, text_batches, tidy

MARK = "▁"
BATCH = 1 << 20
KNOWN_WORDS = 300_000
#: Longer words are not kept for other batches, which bounds the bytes of the words seen before.
KNOWN_LENGTH = 64
KNOWN_PAIRS = 500_000
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def vocabulary(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceModel:
    """Pieces, scores and bytes of a model file, and the forward tables over a trie of words."""

    def __init__(self, path: str, kind: str = "bpe"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if kind not in ("bpe", "unigram"):
            raise ValueError(f"no such kind of model: {kind}")
        self.kind, self.size, self.model = kind, model.get_piece_size(), model
        normal = [
            i
            for i in range(self.size)
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        self.ids = {model.id_to_piece(i): i for i in normal}
        self.scores = {p: model.get_score(i) for p, i in self.ids.items()}
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.ids))
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces of this model reach over word ends")
        # The plain rule, where the model's own normaliser agrees with it on a probe.
        probe = "  a\tb \n éﬁİ x "
        self.plain = model.normalize(probe) == MARK + probe.replace(" ", MARK)
        self.spelt = [b""] * self.size
        for p, i in self.ids.items():
            self.spelt[i] = p.replace(MARK, " ").encode("utf-8")
        for b, i in enumerate(self.bytes):
            self.spelt[i] = bytes([b])
        self.heads = {p[:n] for p in self.ids for n in range(1, len(p) + 1)}
        #: For each piece the pieces, or nothing, before it: do the two stand together?
        self.fits: dict[str, dict[str, bool]] = {}
        self.pairs = 0
        #: What a walk over characters is in the middle of (the longest end of the text that begins a piece), by the
        #: walk before and a character; with it, the pieces that end here, longest first.
        self.steps: dict[str, dict[str, tuple]] = {}
        self.walked = 0
        self.coded = {p: np.array([i], "<i4").tobytes() for p, i in self.ids.items()}

    def marked(self, text: str) -> str:
        if not text:
            return ""
        return MARK + text.replace(" ", MARK) if self.plain else self.model.normalize(text)

    def merged(self, text: str) -> list[str]:
        """The text's characters joined by best score, leftmost first: the rule of BPE, for short texts."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, before: str, piece: str) -> bool:
        """Does merging the joint text leave the two pieces? Nothing before means: is the piece its own encoding?"""
        if self.pairs >= KNOWN_PAIRS:
            self.fits.clear()
            self.pairs = 0
        found = self.merged(before + piece) == ([before, piece] if before else [piece])
        self.fits.setdefault(piece, {})[before] = found
        self.pairs += 1
        return found

    def step(self, walk: str, char: str) -> tuple:
        """The walk after one more character and the pieces that end there, longest first; "" stands for spelt bytes."""
        if self.walked >= KNOWN_PAIRS:
            self.steps.clear()
            self.walked = 0
        text = walk + char
        ends = [text[at:] for at in range(len(text)) if text[at:] in self.ids]
        if char not in self.ids:
            ends.append("")
        while text and text not in self.heads:
            text = text[1:]
        found = (text, tuple(ends))
        self.steps.setdefault(walk, {})[char] = found
        self.walked += 1
        return found

    def encode_words(self, words) -> dict[str, bytes]:
        """The ids of each distinct word, as little-endian int32.

        The words are taken in order. For each prefix of the current word the table holds the walk over its characters
        and its last piece, which is the pointer back to the prefix before it, and for a unigram model its best score;
        the rows of the prefix in common with the word before stay. The pieces are read off backwards once a word ends,
        so a word takes memory in proportion to its length.
        """
        extend = self._extend_unigram if self.kind == "unigram" else self._extend
        out, before = {}, ""
        walks, lasts, best = [""], [""], [0.0]
        for word in sorted(words):
            common = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                common += 1
            del walks[common + 1 :], lasts[common + 1 :], best[common + 1 :]
            extend(word, common, walks, lasts, best)
            out[word], before = self._spelling(word, lasts), word
        return out

    def _extend(self, word: str, common: int, walks: list[str], lasts: list[str], best: list[float]) -> None:
        steps, fits = self.steps, self.fits
        walk, end = walks[-1], common
        for char in word[common:]:
            end += 1
            known = steps.get(walk)
            walk, ends = (known and known.get(char)) or self.step(walk, char)
            for piece in ends:
                size = len(piece)
                if size < 2:
                    break
                last = lasts[end - size]
                held = fits.get(piece)
                fit = held.get(last) if held is not None else None
                if fit is None:
                    fit = self.compatible(last, piece)
                if fit:
                    break
            walks.append(walk)
            lasts.append(piece)

    def _extend_unigram(self, word: str, common: int, walks: list[str], lasts: list[str], best: list[float]) -> None:
        walk = walks[-1]
        for end in range(common + 1, len(word) + 1):
            char = word[end - 1]
            known = self.steps.get(walk)
            walk, ends = (known and known.get(char)) or self.step(walk, char)
            score, _, piece = max((best[end - (len(p) or 1)] + self.scores.get(p, -1e6), -len(p), p) for p in ends)
            walks.append(walk)
            best.append(score)
            lasts.append(piece)

    def _spelling(self, word: str, lasts: list[str]) -> bytes:
        """The ids of a word whose table is complete."""
        at, out, coded = len(word), [], self.coded
        while at:
            piece = lasts[at]
            if piece:
                out.append(coded[piece])
                at -= len(piece)
            else:
                at -= 1
                spelt = [self.bytes[b] for b in word[at].encode("utf-8", "surrogatepass")]
                out.append(np.array(spelt, "<i4").tobytes())
        out.reverse()
        return b"".join(out)

    def decode(self, ids) -> str:
        text = b"".join(map(self.spelt.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class TextEncoder:
    """Ids of whole texts as little-endian int32 bytes, with a bounded table of words seen before."""

    def __init__(self, model: PieceModel):
        self.model, self.known = model, {}

    def words(self, text: str | None) -> list[str]:
        marked = self.model.marked(text or "")
        if not marked:
            return []
        if MARK + MARK in marked or marked.endswith(MARK):
            return _WORD.findall(marked)
        return [MARK + w for w in marked[1:].split(MARK)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        words = [self.words(t) for t in texts]
        fresh = set().union(*words) - self.known.keys()
        if len(self.known) + len(fresh) > KNOWN_WORDS:
            self.known.clear()
            fresh = set().union(*words)
        self.known |= self.model.encode_words(fresh)
        get = self.known.__getitem__
        out = [b"".join(map(get, w)) for w in words]
        for word in fresh:
            if len(word) > KNOWN_LENGTH:
                del self.known[word]
        return out


@functools.cache
def model_of(path: str, kind: str) -> PieceModel:
    return PieceModel(path, kind)


@functools.cache
def encoder_of(path: str, kind: str) -> TextEncoder:
    return TextEncoder(model_of(path, kind))


def encode_column(
    docs: DataFrame, path: str | None = None, kind: str = "bpe", keep_columns: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """``keep_columns`` with ids (array of int), n_ids, ids_crc32, decoded_chars and round_trip of each whole text."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    path = path or vocabulary()
    chosen = docs.select(*keep_columns, *([] if "text" in keep_columns else ["text"]))
    schema = StructType([f for f in chosen.schema.fields if f.name in keep_columns])
    added = "ids array<int>, n_ids bigint, ids_crc32 bigint, decoded_chars bigint, round_trip boolean"
    for f in StructType.fromDDL(added).fields:
        schema = schema.add(f)
    names = [f.name for f in schema.fields]

    def go(batches):
        encoder = encoder_of(path, kind)
        model = encoder.model
        for batch in text_batches(batches, limit=BATCH):
            texts = batch.column("text").to_pylist()
            data = encoder.encode(texts)
            flat = np.frombuffer(b"".join(data), "<i4")
            ends = np.cumsum([len(d) // 4 for d in data])
            starts = np.concatenate([[0], ends]).astype(np.int32)
            chars, same = [], []
            ids = flat.tolist()
            for i, text in enumerate(texts):
                back = model.decode(ids[starts[i] : starts[i + 1]])
                chars.append(len(back))
                same.append(back == (text or "").replace(MARK, " "))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in keep_columns),
                    pa.ListArray.from_arrays(pa.array(starts), pa.array(flat)),
                    pa.array(np.diff(starts).astype(np.int64)),
                    pa.array([zlib.crc32(d) for d in data], pa.int64()),
                    pa.array(chars, pa.int64()),
                    pa.array(same, pa.bool_()),
                ],
                names=names,
            )

    return chosen.mapInArrow(tidy(go), schema)


def decode_column(encoded: DataFrame, path: str | None = None, kind: str = "bpe") -> DataFrame:
    """doc_id and text of (doc_id, ids)."""
    import pyarrow as pa

    path = path or vocabulary()

    def go(batches):
        model = model_of(path, kind)
        for batch in batches:
            texts = [model.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind_of_id = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", "ids").mapInArrow(tidy(go), f"doc_id {kind_of_id}, text string")


def pieces_query(spark, sf_dir: str) -> DataFrame:
    return encode_column(documents(spark, sf_dir))


def pieces_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the ids of every document, with where it came from."""
    return encode_column(docs, keep_columns=("doc_id", "lang", "source")).select(
        "doc_id", "lang", "source", F.col("n_ids").alias("n_tokens"), "ids_crc32", "ids", "round_trip"
    )
