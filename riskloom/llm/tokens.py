"""Token counts with a whole-token shortcut.

A vocabulary string that is *proved* to encode alone as one token (the library is asked about each
entry once, on the driver) is counted directly wherever it occurs; only what is left goes through
the merges. White space never lies inside a pre-token, so a text may be cut there, and each distinct
pre-token is settled once per worker.

Defined results: a null or empty text has no tokens; texts with the separators 0x1C-0x1F, which
the two notions of white space treat differently, are encoded by the library as a whole; a text is counted
whole, at any length; an empty table gives no rows; other columns of the input are not looked at; repeated
rows are counted row by row; a vocabulary that normalises or splits in another way is refused.
"""

from __future__ import annotations

import json
import re
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "word_bpe_49k.json"
#: Fixed value: the split of the vocabularies that the shortcut holds for.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Pre-tokens a worker remembers before it starts anew; bounds its memory, not what is counted.
REMEMBERED = 300_000
_ODD_SPACE = re.compile("[\x1c-\x1f]")
#: White space, printable ASCII and the Latin letters that are already composed and have a plain lower case.
_PLAIN = re.compile("[ \\t-\\r!-~À-ÖØ-öø-įĲ-ž]*")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[^\sa-z0-9ß-öø-ž]+")


def vocabulary_path(name: str) -> str:
    """A path stays a path; a bare file name is looked up among the public tokenizers of this machine."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def load(name: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path(name))


def checked(name: str):
    """The library, if the vocabulary lowers its text and splits it as ``_PIECES`` does; others would get other ids."""
    tokenizer = load(name)
    parts = json.loads(tokenizer.to_str())
    steps = [s["type"] for s in (parts["normalizer"] or {}).get("normalizers", [])]
    splits = [s["pattern"].get("Regex") for s in (parts["pre_tokenizer"] or {}).get("pretokenizers", []) if s["type"] == "Split"]
    if steps != ["NFC", "Replace", "Lowercase"] or splits != [SPLIT] or parts["model"].get("end_of_word_suffix") != "</w>":
        raise ValueError(f"{name} does not normalise and split its text like {VOCABULARY}")
    return tokenizer


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def prove_whole_tokens(name: str = VOCABULARY) -> dict[str, int]:
    """Strings of the vocabulary that the library encodes, alone, as exactly one token."""
    tokenizer, alphabet, strings = checked(name), byte_alphabet(), []
    for entry in tokenizer.get_vocab(with_added_tokens=False):
        word = entry.removesuffix("</w>")
        try:
            string = bytes(alphabet[c] for c in word).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if string and not any(c.isspace() or "\x1c" <= c <= "\x1f" for c in string):
            strings.append(string)
    strings = sorted(set(strings))
    whole = {}
    for a in range(0, len(strings), 2_048):  # the library's results are large beside the ids
        part = strings[a : a + 2_048]
        whole |= {s: e.ids[0] for s, e in zip(part, tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True) if len(e.ids) == 1}
    return whole


class PieceTokenizer:
    """Token ids of whole texts as little-endian unsigned 32-bit integers."""

    def __init__(self, name: str, whole: dict[str, int]):
        self.tokenizer = load(name)
        self.merge = self.tokenizer.model.tokenize
        self.stand_ins = {b: c for c, b in byte_alphabet().items()}
        self.whole = {s: array("I", [i]).tobytes() for s, i in whole.items()}
        self.pieces = dict(self.whole)

    def _plain(self, text: str) -> bytes:
        """Pre-tokens of plain text: looked up if proved or seen, merged otherwise."""
        pieces = _PIECES.findall(text.lower())
        distinct = set(pieces)
        missing = distinct.difference(self.pieces)
        if len(self.pieces) + len(missing) > REMEMBERED:
            self.pieces = dict(self.whole)
            missing = distinct.difference(self.pieces)
        known, merge = self.pieces, self.merge
        for piece in missing:
            units = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.stand_ins)
            known[piece] = array("I", [t.id for t in merge(units)]).tobytes()
        return b"".join(map(known.__getitem__, pieces))

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if "<|" not in text and _PLAIN.fullmatch(text):
            return self._plain(text)
        if _ODD_SPACE.search(text):
            return self._library(text)
        # runs of plain chunks together, any other chunk by the library
        out, run = [], []
        for chunk in text.split():
            if "<|" not in chunk and _PLAIN.fullmatch(chunk):
                run.append(chunk)
            else:
                out += [self._plain(" ".join(run)), self._library(chunk)]
                run = []
        return b"".join([*out, self._plain(" ".join(run))])


_LOADED: dict[str, PieceTokenizer] = {}


def piece_tokenizer(name: str, whole: dict[str, int]) -> PieceTokenizer:
    """One tokenizer for each worker process and vocabulary."""
    if name not in _LOADED:
        _LOADED[name] = PieceTokenizer(name, whole)
    return _LOADED[name]


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs(doc_id, text)``; no shuffle."""
    whole = docs.sparkSession.sparkContext.broadcast(prove_whole_tokens(vocabulary))  # at most the vocabulary

    def count(batches):
        tokenizer = piece_tokenizer(vocabulary, whole.value)
        for batch in batches:
            sizes = [len(tokenizer.encode(t or "")) // 4 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(sizes, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
