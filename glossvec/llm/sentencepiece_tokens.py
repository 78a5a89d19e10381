"""SentencePiece models run by the `tokenizers` library.

The model file is a protobuf; its pieces, scores, kinds and normaliser are read
from the wire format and built anew: normaliser, space marker, BPE merges in the
order of scores or unigram scores, byte fallback, decoder. Tasks encode whole Arrow
batches on the threads of the library; ids are decoded by the pieces read from the
file, and by the library's decoder where those are no UTF-8.

Defined results: a null or empty text has no tokens and decodes to itself; null
ids and repeated rows are encoded like any other; an empty table gives an empty
result; extra columns stay.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossvec.llm.common import text_of

MARK = "▁"
# Fixed values of the format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: One row in so many is held against the sentencepiece library while encoding, unless asked for otherwise; the registered query holds every row.
VERIFIED = 16
#: Texts that are encoded at a time.
BATCH = 256


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    unknown: int = 0
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def _fields(data: bytes):
    """(number, value) of a protobuf message; lengths, varints and fixed words."""

    def varint(at):
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        wire = key & 7
        if wire == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if wire == 2 else ({1: 8, 5: 4}[wire], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def read_model(path: str) -> Model:
    """A model from its file. Field numbers are those of the published format."""
    with open(path, "rb") as f:
        data = f.read()
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            model.pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
        elif number == 2:
            own = dict(_fields(value))
            model.kind, model.byte_fallback, model.unknown = own.get(3, UNIGRAM), bool(own.get(35, 0)), own.get(40, 0)
        elif number == 3:
            own = dict(_fields(value))
            model.charsmap, model.dummy_prefix = own.get(2, b""), bool(own.get(3, 1))
            model.squeeze, model.escape = bool(own.get(4, 1)), bool(own.get(5, 1))
    if model.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    return model


def _merges(model: Model) -> list[tuple[str, str]]:
    """Every way to join two pieces into a third, the best third first."""
    score = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER)}
    ranked = sorted((p for p in score if len(p) > 1), key=lambda p: -score[p])
    return [(p[:k], p[k:]) for p in ranked for k in range(1, len(p)) if p[:k] in score and p[k:] in score]


def plain(model: Model) -> bool:
    """Whether normalising is no more than marking spaces."""
    return not model.charsmap and not model.squeeze and model.escape


def marked(text: str, model: Model) -> str:
    """What the normaliser of a plain model makes of a text."""
    text = text.replace(" ", MARK)
    return MARK + text if text and model.dummy_prefix else text


def build_tokenizer(model: Model, normalise: bool = True):
    """The tokenizer of a model; without its normaliser it takes texts that are `marked`."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    names = [p for p, _, _ in model.pieces]
    if model.kind == BPE:
        core = models.BPE({p: i for i, p in enumerate(names)}, _merges(model), unk_token=names[model.unknown], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unknown, model.byte_fallback)
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape else " "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    if normalise:
        tokenizer.normalizer = normalizers.Sequence(steps)
    tokenizer.add_tokens([AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER])
    tail = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return tokenizer


_BYTE_PIECE = re.compile("<0x[0-9A-Fa-f]{2}>")


def piece_decoder(model: Model, otherwise):
    """A function from ids to text by what each piece of the model stands for.

    The library looks a piece up and runs its decoders piece by piece, at six
    times the cost. Ids that no piece has, and byte pieces that are no UTF-8, go
    to `otherwise`: where the whole is UTF-8, every run of byte pieces in it is.
    """
    plain_pieces = [p.replace(MARK, " ") for p, _, _ in model.pieces]
    held = {i: bytes([int(p[3:5], 16)]) if _BYTE_PIECE.fullmatch(p) else p.encode() for i, p in enumerate(plain_pieces)}

    def decode(ids: list[int]) -> str:
        try:
            text = b"".join(map(held.__getitem__, ids)).decode()
        except (KeyError, UnicodeDecodeError):
            return otherwise(ids)
        return text[1:] if model.dummy_prefix and text.startswith(" ") else text

    return decode


_made: dict = {}


def _tokenizer(path: str):
    """(encode, decode) of batches for a model file, made once in a worker.

    Spaces of a plain model are marked here: the library's normaliser would keep
    track of where every character came from, at a third of its speed.
    """
    if path not in _made:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        model = read_model(path)
        bare = plain(model) and not any(kind == USER for _, _, kind in model.pieces)
        own = build_tokenizer(model, not bare)

        def encode(texts: list[str]) -> list[list[int]]:
            return [e.ids for e in own.encode_batch_fast([marked(t, model) for t in texts] if bare else texts, add_special_tokens=False)]

        decode = piece_decoder(model, lambda ids: own.decode(ids, skip_special_tokens=False))
        _made[path] = (encode, lambda lists: [decode(ids) for ids in lists])
    return _made[path]


def _reference(path: str):
    import sentencepiece

    if ("own", path) not in _made:
        _made["own", path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _made["own", path]


def public_model() -> str:
    import public_tokenizers as p

    return p.path("piece_bpe_32k.model")


def encode_texts(docs: DataFrame, path: str, text: str = "text", verified: int = VERIFIED, with_ids: bool = True) -> DataFrame:
    """`docs` with n_tokens, ids_crc32, round_trip, parity, and ids if asked for.

    round_trip: decoding gives the text again. parity: the sentencepiece library
    has the same ids and the same decoding; asked for one row in `verified`, by a
    hash of the text, and null for others.
    """
    added = {"n_tokens": "bigint", "ids_crc32": "bigint", "round_trip": "boolean", "parity": "boolean"} | ({"ids": "array<int>"} if with_ids else {})
    names = [c for c in docs.columns if c not in added]

    def run(batches):
        import pyarrow as pa

        kinds = {"n_tokens": pa.int64(), "ids_crc32": pa.int64(), "round_trip": pa.bool_(), "parity": pa.bool_(), "ids": pa.list_(pa.int32())}
        encode, decode = _tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                texts = [t or "" for t in part.column(text).to_pylist()]
                found = encode(texts)
                back = decode(found)
                out = {k: [] for k in added}
                for t, ids, b, check in zip(texts, found, back, part.column("__check").to_pylist()):
                    own = np.array(ids, dtype="<u4")
                    out["n_tokens"].append(len(ids))
                    out["ids_crc32"].append(zlib.crc32(own.tobytes()))
                    out["round_trip"].append(b == t)
                    out["parity"].append(_agrees(path, t, own, ids, b) if check else None)
                    if with_ids:
                        out["ids"].append(own.astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [pa.array(v, kinds[k]) for k, v in out.items()], names=[*names, *out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    marked = docs.select(*names, (F.pmod(F.xxhash64(text_of(text)), F.lit(verified)) == 0).alias("__check"))
    return marked.mapInArrow(run, ", ".join([schema, *[f"{k} {v}" for k, v in added.items()]]))


def _agrees(path: str, text: str, own: np.ndarray, ids: list[int], back: str) -> bool:
    library = _reference(path)
    return np.array_equal(library.encode_as_numpy(text), own) and library.decode(ids) == back


def decode_ids(rows: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Add `text` decoded from a column of ids; null ids give an empty text."""
    names = [c for c in rows.columns if c != text]

    def run(batches):
        import pyarrow as pa

        _, decode = _tokenizer(path)
        for batch in batches:
            back = decode([x or [] for x in batch.column(ids).to_pylist()])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(back, pa.string())], names=[*names, text])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    return rows.select(*names).mapInArrow(run, f"{schema}, `{text}` string")


def pieces_query(docs: DataFrame) -> DataFrame:
    out = encode_texts(docs.select("doc_id", "text"), public_model(), verified=1, with_ids=False)
    return out.select("doc_id", "n_tokens", "ids_crc32", "round_trip", "parity")
