"""Token ids of whole texts from a public tokenizer file, for use inside Python workers."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 1
#: Pieces that an encoder remembers, and those where little else needs memory.
MAX_ENTRIES, PIECES = 100_000, 500_000
END = END_ID.to_bytes(4, "little")
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII without the apostrophe
#: Letters that NFC leaves alone and that have one letter of these as their lower case. Of the bytes of the small ones, a byte-level
#: tokenizer writes all but three as the character of that number.
_SIMPLE, _MOVED = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$", (("\x9f", "\u0141"), ("\xa0", "\u0142"), ("\xad", "\u0143"))
#: What a tokenizer does to a text before it merges, if runs of such letters can be handed over in lower case as bytes.
_KNOWN = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
)
_encoders: dict[tuple[str, int], TextEncoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def gather(flat: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The slices flat[begin : begin + length] one after the other."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat((begin - (ends - length)).astype(np.int64), length)
    at += np.arange(total)
    return flat[at]


def _ends(strings: pa.Array, begins: pa.Array) -> pa.Array:
    """What is left of each string (large, no nulls) after its beginning, which begins has."""
    ends = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset + 1 : strings.offset + len(strings) + 1]
    size = np.asarray(pc.binary_length(strings)) - np.asarray(pc.binary_length(begins))
    data = gather(np.frombuffer(strings.buffers()[2], np.uint8), ends - size, size)
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(size, dtype=np.int64)])
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(bounds), pa.py_buffer(data))


def chunked(texts: list[str]) -> tuple[pa.Array, pa.DictionaryArray]:
    """The chunks of each text between U+0020 and line feeds, some empty, as lists and as codes of all lists one after the other."""
    lists = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
    return lists, pc.dictionary_encode(lists.flatten())


def _listed(strings: pa.Array) -> list[str]:
    """As to_pylist, which makes a scalar of each string first."""
    return strings.to_numpy(zero_copy_only=False).tolist()


class TextEncoder:
    """Encodes texts through the tokenizers library, each distinct piece of a group of texts once.

    The tokenizer drops white space and never joins characters across it, so the ids of a text are the
    ids of its chunks one after the other. Chunks are split at U+0020 and line feeds only; other white
    space stays inside chunks and is left to the library. Letters followed by ASCII punctuation (no
    apostrophe) are two pieces to the tokenizer, so such chunks are put together from both. Letter runs go
    to the library many at a time, joined by spaces: each ends in exactly one end-of-word id, and where
    the count of those differs, they are encoded one by one. Runs of ASCII and Latin-1 letters are put in lower case first, as the
    tokenizer would, and go to a copy of it that only merges. Pieces are remembered up to max_entries;
    then those of one group only are forgotten, and if that leaves more than half, those of the fewest groups too, which
    bounds memory without changing results.
    """

    def __init__(self, path: str, max_entries: int = MAX_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        steps = json.loads(self.tokenizer.to_str())
        known = (steps["normalizer"], *(steps["pre_tokenizer"] or {}).get("pretokenizers", ())) == _KNOWN
        self.merger = Tokenizer.from_file(path) if known else None
        if self.merger:
            self.merger.normalizer, self.merger.pre_tokenizer = None, WhitespaceSplit()
        self.max_entries = max_entries
        vocabulary = self.tokenizer.get_vocab()
        self.n_vocabulary = max(vocabulary.values()) + 1
        self.ends = np.zeros(self.n_vocabulary, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.forget()

    @classmethod
    def of_worker(cls, path: str, max_entries: int = MAX_ENTRIES) -> TextEncoder:
        """One encoder for all tasks of a worker process."""
        if (path, max_entries) not in _encoders:
            _encoders[path, max_entries] = cls(path, max_entries)
        return _encoders[path, max_entries]

    def forget(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.flat, self.used = np.zeros(1 << 18, np.uint32), 0
        self.bounds = np.zeros(1 << 16, np.int64)  # of piece i: bounds[i] to bounds[i + 1]
        self.met = np.zeros(1 << 16, np.int32)  # groups that had piece i

    def _make_room(self) -> None:
        n, half = len(self.index), self.max_entries // 2
        met = self.met[:n]
        # Only pieces of several groups; if they are too many, those of the most.
        least = 2 if n <= half else max(2, int(np.partition(met, n - half - 1)[n - half - 1]) + 1)
        again = met >= least
        again[0] = True
        kept, size, met = np.flatnonzero(again), np.diff(self.bounds[: n + 1])[again], met[again] // 2
        flat = gather(self.flat, self.bounds[kept], size)
        names = [x for x, used in zip(self.index, again.tolist(), strict=True) if used]
        self.forget()
        self._add(names, flat, size, 1)
        self.met[: len(met)] = met  # older groups count for less

    def _add(self, names: list[str], ids: np.ndarray, sizes: np.ndarray, first: int) -> None:
        """Remembers pieces and their ids; the first piece, which is empty, may be among them (first is 1)."""
        at = len(self.index) - first
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while at + len(names) + 1 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
            self.met = np.concatenate([self.met, np.zeros_like(self.met)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.bounds[at + 1 : at + len(names) + 1] = self.used + np.cumsum(sizes)
        self.used += len(ids)
        self.index.update(zip(names, range(at, at + len(names)), strict=True))

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after the other, and the number of each."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        coded = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate(coded), np.fromiter(map(len, coded), np.int64, len(coded))

    def _letters(self, words: list[str], simple: bool) -> tuple[np.ndarray, np.ndarray]:
        out, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), 1000):
            part = words[at : at + 1000]
            text = " ".join(part)
            if simple and not text.isascii():
                text = text.encode().decode("latin-1")
                for byte, written in _MOVED:
                    text = text.replace(byte, written)
            by = self.merger if simple else self.tokenizer
            ids = np.array(by.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(part) or stops[-1] != len(ids):
                ids, size = self._whole(part)
            else:
                size = np.diff(stops, prepend=0)
            out.append(ids)
            sizes.append(size)
        return np.concatenate(out), np.concatenate(sizes)

    def _pieces(self, words: list[str], letters: bool, simple: bool = False) -> np.ndarray:
        """The numbers of pieces, which are encoded if they are new. simple: small letters that the merger may have."""
        index = self.index
        out = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(out < 0)
        if len(at):
            new = [words[i] for i in at.tolist()]
            ids, sizes = self._letters(new, simple) if letters else self._whole(new)
            out[at] = np.arange(len(index), len(index) + len(new))  # words are distinct
            self._add(new, ids, sizes, 0)
        self.met[out] += 1
        return out

    def encode_many(self, texts: Iterable[str | None], group_chars: int = 3_000_000) -> Iterator[bytes]:
        """The ids of each whole text as little-endian 32-bit integers, without an end id; null is empty.

        Texts are taken in groups of about group_chars characters.
        """
        group: list[str] = []
        size = 0
        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size >= group_chars:
                yield from self._group(group)
                group, size = [], 0
        if group:
            yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        return self.encode_chunks(*chunked(texts))

    def encode_chunks(self, lists: pa.Array, coded: pa.DictionaryArray) -> Iterator[bytes]:
        """As encode_many, for one group of texts that is chunked."""
        chunks = coded.dictionary
        if len(self.index) + len(chunks) > self.max_entries:
            self._make_room()
        cores = pc.utf8_rtrim(chunks, _PUNCTUATION)
        plain = np.asarray(pc.utf8_is_alpha(cores))
        simple = plain & np.asarray(pc.match_substring_regex(cores, _SIMPLE)) if self.merger else np.zeros(len(chunks), bool)
        # Each distinct chunk is up to two pieces; piece 0 is empty.
        first, second = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        for used in (simple, plain & ~simple):
            if used.any():
                runs = cores.filter(pa.array(used))
                runs = pc.dictionary_encode(pc.utf8_lower(runs) if used is simple else runs)
                first[used] = self._pieces(_listed(runs.dictionary), True, used is simple)[np.asarray(runs.indices)]
        first[~plain] = self._pieces(_listed(chunks.filter(pa.array(~plain))), False)
        tailed = plain & (np.asarray(pc.binary_length(chunks)) > np.asarray(pc.binary_length(cores)))
        if tailed.any():
            tails = pc.dictionary_encode(_ends(chunks.filter(pa.array(tailed)), cores.filter(pa.array(tailed))))
            second[tailed] = self._pieces(_listed(tails.dictionary), False)[np.asarray(tails.indices)]
        both = np.stack([first, second], 1).ravel()
        begin, size = self.bounds[both], self.bounds[both + 1] - self.bounds[both]
        own = gather(self.flat, begin, size)
        size = size.reshape(-1, 2).sum(1)
        begin = np.cumsum(size) - size
        at = np.asarray(coded.indices)
        ids = gather(own, begin[at], size[at]).astype("<u4", copy=False)
        stops = np.concatenate([[0], np.cumsum(size[at])])[np.asarray(lists.offsets)]
        for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True):
            yield ids[a:b].tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(next(self.encode_many([text])), "<u4")
