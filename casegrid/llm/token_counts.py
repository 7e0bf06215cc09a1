"""Token counts: Arrow functions that encode batches and give back lengths only.

Texts longer than ``segment_chars`` are cut at safe boundaries, segments are
gathered into batches of about ``batch_bytes``, and every batch is encoded at
once; only the lengths return to Spark. No text is truncated.

A boundary is safe in front of a space that a character other than white
space follows: the pre-tokenizer of the byte-level vocabularies always ends a
piece there (a run of white space gives up its last space to the next word),
so the parts' counts add up to the whole text's count.
"""

from __future__ import annotations

import base64
import os
import re
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from casegrid.llm.text_tables import read_table

_SAFE = re.compile(r" (?=\S)")
#: Words of up to so many characters are kept, at most so many of them.
_KEEP_CHARS, _KEEP_WORDS = 48, 150_000


def _byte_of_letter() -> dict[str, int]:
    """The printable stand-in for each byte in byte-level vocabularies, reversed."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordCache:
    """Word (with its leading space) -> a value of its ids. A batch's new words are encoded at once.

    Memory is bounded: of the words seen before the last _KEEP_WORDS new ones,
    those that occurred since are kept.
    """

    def __init__(self, encode_batch, value):
        self._encode_batch, self._value = encode_batch, value
        self._held: dict[str, object] = {}
        self._before: dict[str, object] = {}

    def of(self, words: list[str]) -> list:
        fresh = set(words).difference(self._held)
        again = fresh.intersection(self._before)
        new = list(fresh.difference(again))
        if len(self._held) + len(fresh) > _KEEP_WORDS:
            self._held, self._before = {w: self._held[w] for w in set(words).intersection(self._held)}, self._held | {w: self._before[w] for w in again}
        held = self._held
        held.update((w, self._before[w]) for w in again)
        held.update(zip(new, map(self._value, self._encode_batch(new)), strict=True))
        out = [held[w] for w in words]
        for w in new:
            if len(w) > _KEEP_CHARS:
                del held[w]
        return out


class ByteLevelEncoder:
    """Ids of a byte-level BPE vocabulary whose words are encoded independently.

    ``specials`` maps strings that the library turns into one id wherever they
    stand in a text. They hold no white space, so safe boundaries never cut them.
    """

    splittable = True

    def __init__(self, ranks: dict[bytes, int], pattern: str, specials: dict[str, int]):
        import tiktoken

        engine = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        encode = lambda words: map(engine.encode_ordinary, words)
        self._ids, self._counts = WordCache(encode, lambda ids: array("I", ids).tobytes()), WordCache(encode, len)
        self._specials = specials
        self._cut = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None

    def _batch(self, texts: list[str], cache: WordCache, special) -> list[list]:
        """The values of each text's words, and ``special(string)`` where a special string stands."""
        words: list[str] = []
        plan = []  # for each text: how many words follow, or a special string
        for text in texts:
            parts = []
            for part in self._cut.split(text) if self._cut and self._cut.search(text) else [text]:
                if part in self._specials:
                    parts.append(part)
                    continue
                first, *rest = _SAFE.split(part)
                words += [first] if first else []
                words += map(" ".__add__, rest)
                parts.append(len(rest) + bool(first))
            plan.append(parts)
        values, at, out = cache.of(words), 0, []
        for parts in plan:
            own = []
            for p in parts:
                if isinstance(p, str):
                    own.append(special(p))
                else:
                    own += values[at : at + p]
                    at += p
            out.append(own)
        return out

    def counts(self, texts: list[str]) -> list[int]:
        return [sum(x) for x in self._batch(texts, self._counts, lambda s: 1)]

    def ids_of(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes."""
        return [b"".join(x) for x in self._batch(texts, self._ids, lambda s: self._specials[s].to_bytes(4, "little"))]


class LibraryEncoder:
    """A tokenizer used as its library gives it; texts are never split."""

    splittable = False

    def __init__(self, encode_batch):
        self._encode_batch = encode_batch

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self._encode_batch(texts)]

    def ids_of(self, texts: list[str]) -> list[bytes]:
        return [b"".join(i.to_bytes(4, "little") for i in ids) for ids in self._encode_batch(texts)]


_loaded: dict[str, object] = {}


def load_encoder(path: str):
    """The encoder for a tokenizer file, kept for the life of the worker.

    ``.json``: byte-level BPE without a normalizer runs word by word on its own
    ranks with the same ids; any other kind goes through ``tokenizers``.
    ``.model``: ``sentencepiece``. ``.tiktoken``: ``tiktoken``.
    """
    if path not in _loaded:
        _loaded[path] = _load(path)
    return _loaded[path]


def _load(path: str):
    import public_tokenizers

    if path.endswith(".tiktoken"):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return ByteLevelEncoder(ranks, public_tokenizers.PATTERN, {})
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return LibraryEncoder(lambda texts: model.encode(texts, num_threads=1))
    import json

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    added = spec.get("added_tokens", [])
    plain = (
        model["type"] == "BPE" and not spec.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix") and not model.get("ignore_merges")
        and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] or re.search(r"\s", a["content"]) for a in added)
    )
    if plain:
        letters, special = _byte_of_letter(), {a["content"]: a["id"] for a in added}
        ranks = {bytes(letters[c] for c in word): i for word, i in model["vocab"].items() if word not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [model["vocab"][a + b] for a, b in merges]
        if order == sorted(order):  # merge order and id order agree, so ids serve as ranks
            return ByteLevelEncoder(ranks, public_tokenizers.PATTERN, special)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    return LibraryEncoder(lambda texts: [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)])


def segments(text: str, most: int) -> list[str]:
    """Cut ``text`` at safe boundaries into parts of about ``most`` characters; a part without one stays whole."""
    if len(text) <= most:
        return [text]
    out, at = [], 0
    while len(text) - at > most:
        cut = _SAFE.search(text, at + most)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def batched(parts, most: int):
    """Group (owner, text, bytes) into lists of about ``most`` bytes; nothing is dropped."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += part[2]
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def count_tokens(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, segment_chars: int = 1 << 18, batch_bytes: int = 1 << 20) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts count 0 bytes and 0 tokens; rows with equal ids stay
    separate rows; other columns are not read, so clashing names don't matter;
    an empty table gives an empty result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def counted(batches):
        encoder = load_encoder(tokenizer)
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                texts = part.column(1).to_pylist()
                sizes, totals = [0] * len(texts), [0] * len(texts)

                def cut(texts=texts, sizes=sizes):
                    for k, text in enumerate(texts):
                        sizes[k] = len(text.encode()) if text else 0
                        if text:
                            pieces = segments(text, segment_chars) if encoder.splittable else [text]
                            for piece in pieces:
                                yield k, piece, sizes[k] // len(pieces)

                for group in batched(cut(), batch_bytes):
                    for (k, _, _), n in zip(group, encoder.counts([g[1] for g in group]), strict=True):
                        totals[k] += n
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array([n > limit for n in totals], pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(counted, f"`{id_col}` {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
