"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is parsed here; from it the tokenizer is rebuilt: its normaliser (precompiled
character map, white space rules, dummy prefix), the metaspace marker, unigram scores or, for a BPE model,
the merges that its scores imply, byte fallback and the decoder. Batches are encoded by several threads.

Where no piece has the marker behind another sign (which is checked on the vocabulary), words can't
influence each other: each distinct word of a worker's texts is encoded once, in large calls, and texts are
put together from words. Else whole texts are encoded. Parity compares the ids of each whole text with those
that the sentencepiece library gives the whole text; the round trip puts the bytes of all pieces of a text
together and compares them with the text. (A text that holds the marker itself can't come back.)

Null and empty texts have no pieces and decode to the empty text. Special pieces in a text are ordinary
text. Each row is treated by itself, so repeated rows agree.
"""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass, field as data_field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import field, map_columns

MARKER = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
_MARK, _CUT = MARKER.encode(), b"\xff"  # a byte that no text holds
WORDS = MARKER + "*[^" + MARKER + "]+|" + MARKER + "+"
#: New words that are encoded as one text.
WORDS_AT_ONCE = 2_000
#: Such texts in one call, which is dealt to threads.
GROUPS_AT_ONCE = 8
#: Bytes of words (and 100 a word) that a worker keeps with their ids.
KNOWN_CHARS = 25_000_000
THREADS = 2


@dataclass
class Spec:
    pieces: list[tuple[str, float, int]] = data_field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    marker_behind: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True


def fields(data: bytes):
    """Number and value of each field of a protobuf message: int, bytes, or a float for 32 bits."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value = varint()
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            n = varint()
            value, at = data[at : at + n], at + n
        elif kind == 5:
            (value,), at = struct.unpack("<f", data[at : at + 4]), at + 4
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, value


def parse_model(data: bytes) -> Spec:
    spec = Spec()
    for number, value in fields(data):
        if number == 1:
            piece = {1: b"", 2: 0.0, 3: NORMAL} | dict(fields(value))
            spec.pieces.append((piece[1].decode(), piece[2], piece[3]))
        elif number == 2:
            trainer = dict(fields(value))
            spec.model_type = trainer.get(3, UNIGRAM)
            spec.byte_fallback = bool(trainer.get(35, 0))
            spec.unk_id = trainer.get(40, 0)
            spec.marker_behind = bool(trainer.get(24, 0))
        elif number == 3:
            rules = dict(fields(value))
            spec.charsmap = rules.get(2, b"")
            spec.dummy_prefix, spec.remove_extra, spec.escape = (bool(rules.get(k, 1)) for k in (3, 4, 5))
    if spec.model_type not in (UNIGRAM, BPE) or spec.marker_behind or any(kind == USER_DEFINED for _, _, kind in spec.pieces):
        raise ValueError("only unigram and BPE models with the marker in front and without user-defined pieces are supported")
    return spec


def splits_at_markers(spec: Spec) -> bool:
    """Whether no piece has a marker behind another sign, so that words are independent."""
    return spec.escape and not any(kind == NORMAL and MARKER in piece.lstrip(MARKER) for piece, _, kind in spec.pieces)


def merges_of(spec: Spec) -> list[tuple[str, str]]:
    """All pairs of pieces that make a piece, the best score first; of one piece the pair of the smallest ids first."""
    ids = {piece: k for k, (piece, _, kind) in enumerate(spec.pieces) if kind == NORMAL}
    ranked = []
    for piece, k in ids.items():
        for i in range(1, len(piece)):
            left, right = piece[:i], piece[i:]
            if left in ids and right in ids:
                ranked.append((-spec.pieces[k][1], k, ids[left], ids[right], left, right))
    return [(r[4], r[5]) for r in sorted(ranked)]


def build_tokenizer(spec: Spec) -> str:
    """The tokenizer as JSON."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unknown = spec.pieces[spec.unk_id][0]
    if spec.model_type == UNIGRAM:
        model = models.Unigram([(piece, score) for piece, score, _ in spec.pieces], spec.unk_id, spec.byte_fallback)
    else:
        vocab = {piece: k for k, (piece, _, _) in enumerate(spec.pieces)}
        model = models.BPE(vocab, merges_of(spec), unk_token=unknown, fuse_unk=True, byte_fallback=spec.byte_fallback)
    tokenizer = Tokenizer(model)
    steps: list = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.remove_extra:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.dummy_prefix:
        steps.append(normalizers.Prepend(MARKER if spec.escape else " "))
    if spec.escape:
        steps.append(normalizers.Replace(" ", MARKER))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if splits_at_markers(spec):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(WORDS), "isolated")
    back = [decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence(back + [decoders.Strip(" ", 1, 0)] * spec.dummy_prefix)
    return tokenizer.to_str()


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_model(path: str | None = None) -> bytes:
    with open(path or default_model(), "rb") as f:
        return f.read()


class Codec:
    """Where words are independent, each distinct word is encoded once, in large calls, and texts are put together from words as buffers."""

    def __init__(self, model: bytes, spec: Spec, tokenizer: str, threads: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.tokenizer, self.by_word, self.dummy_prefix = Tokenizer.from_str(tokenizer), splits_at_markers(spec), spec.dummy_prefix
        self.only_marks = spec.dummy_prefix and spec.escape and not spec.charsmap and not spec.remove_extra
        self.reference = SentencePieceProcessor(model_proto=model)
        self.bytes_of = pa.array([bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARKER, " ").encode() for p, _, kind in spec.pieces], pa.large_binary())
        self.opens = np.array([kind == NORMAL and p.startswith(MARKER) for p, _, kind in spec.pieces])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}  # number of a word
        self.words = pa.array([], pa.large_list(pa.int32()))  # ids of each word
        self.chars = 0

    def _normal(self, texts: pa.Array) -> pa.Array:
        """The texts as the model's normaliser leaves them, as bytes."""
        if not self.only_marks:
            normal = [self.tokenizer.normalizer.normalize_str(t) for t in texts.to_pylist()]
            return pa.array(normal, pa.large_string()).cast(pa.large_binary())
        marked = pc.replace_substring(texts.cast(pa.large_binary()), b" ", _MARK)
        return pc.if_else(pc.equal(pc.binary_length(marked), 0), marked, pc.binary_join_element_wise(pa.scalar(_MARK, pa.large_binary()), marked, pa.scalar(b"", pa.large_binary())))

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """How many words each text has, and all words: a word starts where markers start."""
        cut = pc.replace_substring(self._normal(texts), _MARK, _CUT + _MARK)
        while pc.any(pc.match_substring(cut, _MARK + _CUT + _MARK)).as_py():  # markers in a row are one start
            cut = pc.replace_substring(cut, _MARK + _CUT + _MARK, _MARK + _MARK)
        words = pc.split_pattern(cut, _CUT)
        full = pc.greater(pc.binary_length(words.flatten()), 0)
        ends = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
        return np.diff(ends[words.offsets.to_numpy()]), words.flatten().filter(full)

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        """Words of one marker are encoded many at a time, as one text: the pieces that open with a marker tell them apart."""
        odd = [w for w in words if w.rfind(_MARK) or len(w) == len(_MARK)]
        plain = [w for w in words if not w.rfind(_MARK) and len(w) > len(_MARK)]
        groups = [plain[at : at + WORDS_AT_ONCE] for at in range(0, len(plain), WORDS_AT_ONCE)]
        made: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        coded = (ids for at in range(0, len(groups), GROUPS_AT_ONCE) for ids in self._each([b"".join(g).decode()[1:].replace(MARKER, " ") for g in groups[at : at + GROUPS_AT_ONCE]]))
        for group, ids in zip(groups, coded, strict=True):
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) != len(group) or starts[0]:  # the marker itself is no piece
                apart = self._each([w.decode()[1:] for w in group])
                ids, starts = np.concatenate(apart), np.cumsum([0, *map(len, apart[:-1])])
            made.append(ids)
            sizes.append(np.diff(starts, append=len(ids)))
        order = plain
        if odd:
            # A word without its first marker is a text that normalises to the word. No text normalises to a single marker: it is what a space adds to a word.
            short, longer = self._each(["a", "a "])
            found = [longer[len(short) :] if w == _MARK else ids for w, ids in zip(odd, self._each([w.decode().removeprefix(MARKER).replace(MARKER, " ") for w in odd]), strict=True)]
            made += found
            sizes.append(np.array([len(i) for i in found]))
            order = plain + odd
        self.known.update(zip(order, range(len(self.known), len(self.known) + len(order)), strict=True))
        self.chars += sum(map(len, order)) + 100 * len(order)
        new = _lists(np.concatenate(sizes), np.concatenate(made))
        self.words = pa.concat_arrays([self.words, new])

    def _by_word(self, texts: pa.Array) -> pa.LargeListArray:
        counts, flat = self._words(texts)
        coded = flat.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if self.chars > KNOWN_CHARS:  # bounded memory
            self._forget()
        if fresh := [w for w in distinct if w not in self.known]:
            self._learn(fresh)
        numbers = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        ids = self.words.take(pa.array(numbers[coded.indices.to_numpy()]))
        ends = np.concatenate([[0], np.cumsum(counts)])
        return pa.LargeListArray.from_arrays(pa.array(_starts(ids)[ends]), ids.flatten())

    def encode(self, texts: pa.Array) -> pa.LargeListArray:
        """The ids of each text; a null has none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.by_word:
            return self._by_word(texts)
        made = self._each(texts.to_pylist())
        return _lists(np.array([len(i) for i in made], np.int64), np.concatenate([np.empty(0, np.int32), *made]))

    def agree(self, texts: pa.Array, ids: pa.LargeListArray) -> np.ndarray:
        """Whether the sentencepiece library gives each whole text these ids."""
        made = self.reference.encode(pc.fill_null(texts, "").to_pylist(), num_threads=1)  # whole texts: more threads cost more than they save
        lengths = np.fromiter(map(len, made), np.int64, len(made))
        own = np.diff(_starts(ids))
        good = lengths == own
        if good.all():
            other = np.fromiter(chain.from_iterable(made), np.int32, int(lengths.sum()))
            apart = np.flatnonzero(ids.flatten().to_numpy() != other)
            good[np.searchsorted(np.cumsum(own), apart, side="right")] = False
            return good
        for k in np.flatnonzero(good):
            good[k] = ids[int(k)].as_py() == made[k]
        return good

    def comes_back(self, texts: pa.Array, ids: pa.LargeListArray) -> list[bool]:
        """Whether the bytes of each text's pieces, put together, are the text."""
        pieces = self.bytes_of.take(ids.flatten())
        starts = np.frombuffer(pieces.buffers()[1], np.int64, len(pieces) + 1, 8 * pieces.offset)[_starts(ids)].tolist() if len(pieces) else [0] * (len(ids) + 1)
        data = memoryview(pieces.buffers()[2] or b"")
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        out = []
        for text, a, b in zip(texts, starts[:-1], starts[1:], strict=True):
            a += self.dummy_prefix and a < b and data[a : a + 1] == b" "
            out.append(data[a:b] == text.as_buffer())
        return out

    def decode(self, ids: pa.Array) -> list[str]:
        out: list[str] = []
        for at in range(0, len(ids), 50):
            out += self.tokenizer.decode_batch([i or [] for i in ids.slice(at, 50).to_pylist()], skip_special_tokens=False)
        return out


def _starts(lists: pa.LargeListArray) -> np.ndarray:
    """Where each list starts in the flattened values, and the end."""
    starts = lists.offsets.to_numpy()
    return starts - starts[0]


def _lists(lengths: np.ndarray, values: np.ndarray) -> pa.LargeListArray:
    return pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)), pa.array(values, pa.int32()))


def _codec(df: DataFrame, model_path: str | None, threads: int):
    """What makes the codec, once in each task: its words must not stay in a worker that goes on with other work."""
    model = read_model(model_path)
    spec = parse_model(model)
    shared = df.sparkSession.sparkContext.broadcast((model, spec, build_tokenizer(spec)))
    state: dict[str, Codec] = {}

    def get() -> Codec:
        return state.get("codec") or state.setdefault("codec", Codec(*shared.value, threads))

    return get


def encode(df: DataFrame, text: str = "text", carry: list[str] | None = None, model_path: str | None = None, threads: int = THREADS) -> DataFrame:
    """doc (a struct of the columns to carry), ids and parity of every row."""
    get = _codec(df, model_path, threads)
    rows = df.select(F.struct(*[field(c) for c in (df.columns if carry is None else carry)]).alias("doc"), F.coalesce(field(text), F.lit("")).alias("text"))

    def run(batch: pa.RecordBatch) -> list:
        ids = get().encode(batch.column(1))
        return [batch.column(0), ids, get().agree(batch.column(1), ids)]

    return map_columns(rows, run, "ids array<int>, parity boolean", rows.schema["doc"])


def decode(df: DataFrame, ids: str = "ids", carry: list[str] | None = None, model_path: str | None = None, threads: int = THREADS) -> DataFrame:
    """doc (a struct of the columns to carry) and text of every row; null ids give the empty text."""
    get = _codec(df, model_path, threads)
    rows = df.select(F.struct(*[field(c) for c in (df.columns if carry is None else carry)]).alias("doc"), field(ids).cast("array<int>").alias("ids"))

    def run(batch: pa.RecordBatch) -> list:
        return [batch.column(0), get().decode(batch.column(1))]

    return map_columns(rows, run, "text string", rows.schema["doc"])


def encoded_and_back(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model_path: str | None = None, threads: int = THREADS) -> DataFrame:
    """One row for each row: doc_id, n_tokens, ids, parity (with the sentencepiece library), round_trip (decoding gives the text)."""
    rows = docs.select(field(doc_id).alias("doc_id"), F.coalesce(field(text), F.lit("")).alias("text"))
    get = _codec(docs, model_path, threads)

    def run(batch: pa.RecordBatch) -> list:
        codec, texts = get(), batch.column(1)
        ids = codec.encode(texts)
        return [batch.column(0), pc.list_value_length(ids), ids, codec.agree(texts, ids), codec.comes_back(texts, ids)]

    return map_columns(rows, run, "n_tokens bigint, ids array<int>, parity boolean, round_trip boolean", rows.schema["doc_id"])
