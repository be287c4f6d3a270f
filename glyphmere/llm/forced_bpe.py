"""BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never lie inside an
output token, so every place where such a pair stands is a certain cut: no
merge crosses it. Words are cut there, the fragments are merged independently
(and remembered, since they are short and repeat), and their ids concatenated.

Null text counts as empty: no tokens, empty decoding. Ids of repeated or equal
rows are equal; nothing depends on other rows. Whole texts are processed, a
word at a time, so a very long text needs memory for its own ids only.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from glyphmere.llm._common import Recent, as_bytes, slices

#: Entries of each worker's memo of words, and of fragments.
WORDS_KEPT, FRAGMENTS_KEPT = 250_000, 150_000
END = "</w>"


class ForcedBoundaryCodec:
    """Encoder and decoder for one ``tokenizers`` JSON file with a BPE model."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.vocab = spec["model"], spec["model"]["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pairs = [(a, b) for a, b in pairs]
        suffix = {"end_of_word_suffix": self.end} if self.end else {}
        self.ending, self.inner = BPE(self.vocab, pairs, **suffix), BPE(self.vocab, pairs)
        self.pairs = self._pairs_inside(self.vocab)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        #: Only where normalising an ASCII word is lower-casing it, and the pattern is the usual one of word-level files.
        self.ascii_pattern = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+") if kinds == ["NFC", "Replace", "Lowercase"] and r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in json.dumps(spec["pre_tokenizer"]).replace("\\\\", "\\") else None
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.words = Recent(self._word, WORDS_KEPT)
        self.fragments = Recent(self._merge, FRAGMENTS_KEPT)

    def _pairs_inside(self, tokens) -> set[tuple[str, str]]:
        """The pairs of bytes (as letters) that stand side by side in some token."""
        found = set()
        for token in tokens:
            body = token[: -len(self.end)] if self.end and token.endswith(self.end) else token
            found.update(zip(body, body[1:]))
        return found

    def fragments_of(self, letters: str) -> list[str]:
        """A pre-token (in byte letters) cut at every forced boundary."""
        if len(letters) < 2:
            return [letters]
        pairs = self.pairs
        out, start = [], 0
        for i, pair in enumerate(zip(letters, letters[1:]), 1):
            if pair not in pairs:
                out.append(letters[start:i])
                start = i
        out.append(letters[start:])
        return out

    def _merge(self, fragment: str) -> tuple[int, ...]:
        """BPE of one fragment; a leading line feed marks one that its word doesn't end with."""
        found = self.inner.tokenize(fragment[1:]) if fragment[0] == "\n" else self.ending.tokenize(fragment)
        return tuple(t.id for t in found)

    def _pre_tokens(self, raw: bytes) -> list[str]:
        """The library's normalised pre-tokens in byte letters. Printable ASCII needs only its pattern."""
        text = raw.decode("utf-8")
        if raw.isascii() and self.ascii_pattern is not None and text.isprintable():  # then each byte's letter is itself
            return self.ascii_pattern.findall(text.lower())
        if self.lib.normalizer is not None:
            text = self.lib.normalizer.normalize_str(text)
        return [letters for letters, _ in self.lib.pre_tokenizer.pre_tokenize_str(text)]

    def _plain_ids(self, raw: bytes) -> list[int]:
        ids: list[int] = []
        for letters in self._pre_tokens(raw):
            *inner, last = self.fragments_of(letters)
            for fragment in inner:
                ids.extend(self.fragments["\n" + fragment])
            ids.extend(self.fragments[last])
        return ids

    def _word(self, raw: bytes) -> tuple[int, bytes, bytes]:
        """Number of ids, the ids as text, their tokens, of one run of non-white bytes."""
        ids: list[int] = []
        if b"<" in raw and self.split_special and self.split_special.search(text := raw.decode("utf-8")):
            for part in self.split_special.split(text):
                ids.extend([self.special[part]] if part in self.special else self._plain_ids(part.encode()))
        else:
            ids = self._plain_ids(raw)
        return len(ids), " ".join(map(str, ids)).encode(), " ".join(self.names[i] for i in ids).encode()

    def encode(self, text: str | bytes | None) -> list[int]:
        raw = text.encode() if isinstance(text, str) else text or b""
        return [int(i) for w in map(self.words.__getitem__, raw.split()) if w[0] for i in w[1].split()]

    def decode(self, ids: list[int]) -> str:
        """As ``Tokenizer.decode(ids, skip_special_tokens=False)`` of a file without a decoder: tokens joined by a space."""
        return " ".join(self.names[i] for i in ids if i in self.names)

    def digest(self, raw: bytes) -> tuple[int, str, str]:
        """n_tokens, SHA-256 of the ids as text, SHA-256 of the decoded text."""
        found = [w for w in map(self.words.__getitem__, raw.split()) if w[0]]
        return (
            sum(w[0] for w in found),
            hashlib.sha256(b" ".join([w[1] for w in found])).hexdigest(),
            hashlib.sha256(b" ".join([w[2] for w in found])).hexdigest(),
        )


_codecs: dict[str, ForcedBoundaryCodec] = {}


def codec(path: str) -> ForcedBoundaryCodec:
    if path not in _codecs:
        _codecs[path] = ForcedBoundaryCodec(path)
    return _codecs[path]


def encode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` (array of int) and ``decoded`` of every row. Only the two named columns are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for batch in slices(batches, "t"):
            ids = [c.encode(t) for t in as_bytes(batch.column("t"))]
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids], pa.string())], ["i", "ids", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("i"), df[text_col].alias("t")).mapInArrow(run, f"i {kind}, ids array<int>, decoded string").withColumnRenamed("i", id_col)


def digests(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_tokens, ids_sha256, decoded_sha256 of every row; the ids themselves never leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for batch in slices(batches, "t"):
            found = [c.digest(t or b"") for t in as_bytes(batch.column("t"))]
            n, a, b = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["i", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("i"), df[text_col].alias("t")).mapInArrow(run, f"i {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("i", id_col)
