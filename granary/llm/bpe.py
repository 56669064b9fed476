"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A file of ranks (base64 token, rank) becomes a tokenizers model: each byte is written as its printable character, and
the merge that makes a token is found by running the lower ranks over the token's bytes. Ids equal ranks. Decoding
reverses the byte table; a character whose bytes are split over tokens comes back whole from the joined bytes.

Defined results: null text is encoded as the empty text (no ids). Any text decodes to its own UTF-8 bytes. Each batch is a
few documents (``maxRecordsPerBatch``); a worker holds one batch and one document's ids. Extra columns are kept.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, tidy


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@functools.cache
def byte_table() -> list[str]:
    """The printable character of each byte: itself where printable, else the next free one from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The last merge that makes token: what is left when only lower ranks are merged."""
    parts, top = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        at, best = -1, top
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1], top)
            if r < best:
                at, best = i, r
        if at < 0:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


@functools.cache
def encoder(path: str, pattern: str):
    """(tokenizer, bytes of each id). Made once in a worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, chars = read_ranks(path), byte_table()
    shown = lambda b: "".join(chars[x] for x in b)
    merges = [m for t in sorted(ranks, key=ranks.get) if len(t) > 1 and (m := merge_of(t, ranks))]
    model = models.BPE({shown(t): r for t, r in ranks.items()}, [(shown(a), shown(b)) for a, b in merges], ignore_merges=True, cache_capacity=100_000)
    t = Tokenizer(model)
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    back = [b""] * (max(ranks.values()) + 1)
    for b, r in ranks.items():
        back[r] = b
    return t, back


#: Distinct words whose ids a worker keeps; past it the memory starts anew.
KEPT = 100_000


def chunks(text: str) -> list[str]:
    """Cuts text at single spaces between two characters that are no white space. No match of the pattern spans
    such a place (a space is only ever the first character of a word's match), so the parts are encoded one by one.
    The space that a part but the first begins with is left out."""
    parts = text.split(" ")
    out = parts[:1]
    for piece in parts[1:]:
        if piece and not piece[0].isspace() and out[-1] and not out[-1][-1].isspace():
            out.append(piece)
        else:
            out[-1] += " " + piece
    return out


class Encoder:
    """Matches of the pattern become byte characters and go through the tokenizers model, each distinct one once."""

    def __init__(self, model, pattern: str):
        self.model = model
        for a, b in ((r"[^\s", r"[^\p{White_Space}"), (r"\s", r"\p{White_Space}"), (r"\S", r"\P{White_Space}")):
            pattern = pattern.replace(a, b)
        self.find = regex.compile(pattern).findall
        self.chars = str.maketrans(dict(enumerate(byte_table())))
        self.spaced: dict[str, bytes] = {}
        self.matches: dict[str, bytes] = {}

    def ids(self, m: str) -> bytes:
        """The ids of one match."""
        shown = m.replace(" ", "Ġ") if m.isascii() and m.isprintable() else m.encode().decode("latin-1").translate(self.chars)
        return array("I", [x.id for x in self.model.tokenize(shown)]).tobytes()

    def part(self, c: str) -> bytes:
        """The ids of any text, by its matches."""
        return b"".join([self.matches.get(m) or self.matches.setdefault(m, self.ids(m)) for m in self.find(c)])

    def word(self, c: str) -> bytes:
        """The ids of a word with a space before it. Letters alone are one match, and so is one mark after them."""
        if c.isalpha():
            return self.ids(" " + c)
        if c[-1:] in (".", ",") and c[:-1].isalpha():
            return (self.spaced.get(c[:-1]) or self.ids(" " + c[:-1])) + self.part(c[-1])
        return self.part(" " + c)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(self.spaced) + len(self.matches) > 2 * KEPT:
            self.spaced.clear()
            self.matches.clear()
        out = self._known(text.split(" "), False)
        out = self._known(chunks(text), True) if out is None else out
        return out if sys.byteorder == "little" else np.frombuffer(out, ">u4").astype("<u4").tobytes()

    def _known(self, parts: list[str], any_part: bool) -> bytes | None:
        """None if a cut lies beside other white space. Only parts without any at their ends are kept."""
        if not any_part and (not parts[0] or parts[0][-1].isspace()):
            return None if len(parts) > 1 else self.part(parts[0])
        out = [self.part(parts[0])]
        spaced = self.spaced
        for c in parts[1:]:
            x = spaced.get(c)
            if x is None:
                clean = c and not c[0].isspace() and not c[-1].isspace()
                if not (clean or any_part):
                    return None
                a, *lines = c.split("\n")
                if lines and a and all(lines) and not any(y[0].isspace() or y[-1].isspace() for y in (a, *lines)):
                    x = (spaced.get(a) or self.word(a)) + b"".join([self.part("\n") + self.part(y) for y in lines])
                else:
                    x = self.word(c)
                if clean and not lines:
                    spaced[c] = x
            out.append(x)
        return b"".join(out)


def decode_ids(ids: bytes, back: list[bytes]) -> bytes:
    """The bytes of ids (little-endian unsigned 32-bit integers)."""
    return b"".join([back[i] for i in np.frombuffer(ids, "<u4").tolist()])


def encode_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None,
    offsets: bool = False, digest: bool = False,
) -> DataFrame:
    """(id, n_tokens, ids array<int>[, offsets array<int>]): offsets are the code points at which tokens begin.
    digest: (id, n_tokens, ids_sha256, decoded_sha256) in place of the ids."""
    import public_tokenizers

    ranks_path, pattern = ranks_path or default_ranks(), pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, back = encoder(ranks_path, pattern)
        encode = Encoder(t.model, pattern).encode
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [x or "" for x in part.column(1).to_pylist()]
                if offsets:
                    encoded = t.encode_batch(texts, add_special_tokens=False)
                    ids = [np.asarray(e.ids, dtype="<u4").tobytes() for e in encoded]
                else:
                    ids = [encode(x) for x in texts]
                out = {"id": part.column(0), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64())}
                if digest:
                    out["ids_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in ids])
                    out["decoded_sha256"] = pa.array([hashlib.sha256(decode_ids(x, back)).hexdigest() for x in ids])
                else:
                    out["ids"] = pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32()))
                    if offsets:
                        out["offsets"] = pa.array([[a for a, _ in e.offsets] for e in encoded], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>" + ", offsets array<int>" * offsets)
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(lambda batches: tidy(run(batches)), schema)


def decode_documents(encoded: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """(id, text) of (id, ids). Bytes that are no UTF-8 (ids cut in a character) become U+FFFD."""
    ranks_path = ranks_path or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(ranks_path)
        back = [b""] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            back[r] = b
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield pa.RecordBatch.from_pydict({"id": part.column(0), "text": pa.array([decode_ids(np.asarray(x or [], "<u4").tobytes(), back).decode("utf-8", "replace") for x in part.column(1).to_pylist()], pa.string())})

    kind = dict(encoded.dtypes)["id"]
    return encoded.select("id", "ids").mapInArrow(run, f"id {kind}, text string")


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("id", "doc_id")
