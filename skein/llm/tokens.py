"""Token ids with the tokenizers library, each distinct word once.

The word_bpe vocabulary drops white space before it merges, and cuts words into runs of letters, single digits and runs
of other characters, so a text's ids are those of its words in order, and a word's are those of its pieces. Arrow splits
a chunk of texts and numbers its distinct words; those that are not in the caches are cut into pieces, the new pieces
are encoded as one string, which is cut again after the tokens that end a piece, and numpy puts the texts together from
the words' numbers. Words outside the Latin blocks or with special tokens go to the tokenizer whole. Tests hold all this
against encoding whole texts.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

#: What a Python worker keeps; the rest is encoded anew in each chunk.
CACHE_WORDS, CACHE_PIECES, CACHE_BYTES = 200_000, 200_000, 48
#: Bytes of text that are encoded at a time, or one text; words that are put together at a time.
CHUNK_BYTES, CHUNK_WORDS = 2 << 20, 1 << 18
#: Pieces that are encoded as one string.
JOINED = 512
#: What the vocabulary ends a piece's last token with (a fixed value).
SUFFIX = "</w>"
#: What the vocabulary's pre-tokenizer cuts off after an apostrophe (fixed values).
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
LETTER, DIGIT, OTHER, SPACE = range(4)
#: Code points that a word of the Latin blocks can hold, also after its normalisation.
TABLE = 0x2300
#: İ, Ⱥ and Ⱦ are among the words for the tokenizer: the lower case of the first is two characters, which would be
#: normalised again, and that of the others is beyond TABLE.
WHOLE = re.compile("[^\x20-\x7e\xa1-ͯ]|[İȺȾ]|<\\|")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> np.ndarray:
    """The letter that stands for each byte in a byte-level vocabulary, as a code point; the space stays one, as it only separates."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = np.zeros(256, np.uint32)
    out[shown] = shown
    rest = np.setdiff1d(np.arange(256), shown)
    out[rest] = 256 + np.arange(len(rest))
    out[32] = 32
    return out


@lru_cache(1)
def kinds() -> np.ndarray:
    """LETTER, DIGIT, OTHER or SPACE of each code point below TABLE."""
    out = np.array([{"L": LETTER, "N": DIGIT}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(TABLE)], np.uint8)
    out[32] = SPACE
    return out


def piece_starts(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces start in a string of words with a space between each two, and which of them are such a space.

    A piece is a run of letters, one digit or a run of others; an apostrophe that starts one takes an ending along."""
    kind = kinds()[points]
    first = np.ones(len(points), bool)
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT) | (kind[1:] == SPACE)
    marks = np.flatnonzero(first & (points == 39))
    for ending in ENDINGS if len(marks) else ():
        n = len(ending)
        at = marks[marks + n < len(points)]
        for j, letter in enumerate(ending, 1):
            at = at[points[at + j] == ord(letter)]
        first[at + 1] = False
        after = at[at + n + 1 < len(points)] + n + 1
        first[after] = True
    found = np.flatnonzero(first)
    return found, kind[found] == SPACE


def starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


class Rows:
    """Rows of ids, one after the other: row i is ids[at[i] : at[i + 1]]."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        self.ids, self.at = ids, starts(lengths)

    def __len__(self) -> int:
        return len(self.at) - 1

    def take(self, which: np.ndarray) -> Rows:
        first, n = self.at[which], self.at[which + 1] - self.at[which]
        at = starts(n)
        return Rows(self.ids[np.arange(at[-1]) + np.repeat(first - at[:-1], n)], n)

    def plus(self, other: Rows) -> Rows:
        return Rows(np.concatenate([self.ids, other.ids]), np.diff(np.concatenate([self.at, self.at[-1] + other.at[1:]])))


def no_rows() -> Rows:
    return Rows(np.empty(0, np.uint32), np.empty(0, np.int64))


class Known:
    """Keys to rows; of new ones it keeps the short, up to so many."""

    def __init__(self, most: int):
        self.number, self.rows, self.most = {}, no_rows(), most

    def look_up(self, keys: list, find) -> Rows:
        """Rows of distinct keys, in their order; find(those that are missing) gives the rest."""
        where = np.fromiter(map(self.number.get, keys, (-1 for _ in keys)), np.int64, len(keys))
        absent = np.flatnonzero(where < 0)
        if not len(absent):
            return self.rows.take(where)
        fresh = [keys[i] for i in absent.tolist()]
        found, n = find(fresh), len(self.rows)
        where[absent] = n + np.arange(len(absent))
        out = self.rows.plus(found).take(where)
        keep = [i for i, k in enumerate(fresh) if len(k) <= CACHE_BYTES][: max(0, self.most - n)]
        if keep:
            self.number.update(zip([fresh[i] for i in keep], range(n, n + len(keep)), strict=True))
            self.rows = self.rows.plus(found.take(np.array(keep)))
        return out


class WordIds:
    """Ids of words (UTF-8 bytes without white space)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.words, self.pieces = Tokenizer.from_file(path), Known(CACHE_WORDS), Known(CACHE_PIECES)
        # the same model for pieces, which are normalised, spelt in byte letters and need no pattern
        self.by_space = Tokenizer(self.tokenizer.model)
        self.by_space.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = byte_letters()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(SUFFIX)]] = True

    def whole(self, texts: list[str]) -> Rows:
        ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return Rows(np.concatenate(ids), np.array([len(x) for x in ids])) if ids else no_rows()

    def joined(self, pieces: list[str]) -> Rows:
        """Ids of each piece. A string that does not give as many ends as pieces is encoded piece by piece."""
        ids, lengths = [], []
        for at in range(0, len(pieces), JOINED):
            part = pieces[at : at + JOINED]
            text = " ".join(part)
            if not text.isascii():
                text = self.letters[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-32-le")
            got = np.array(self.by_space.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[got]) + 1
            if len(ends) == len(part) and ends[-1] == len(got):
                ids.append(got)
                lengths.append(np.diff(ends, prepend=0))
            else:
                rows = self.whole(part)
                ids.append(rows.ids)
                lengths.append(np.diff(rows.at))
        return Rows(np.concatenate(ids), np.concatenate(lengths))

    def find(self, missing: list[bytes]) -> Rows:
        text = b" ".join(missing).decode("utf-8", "replace")
        odd = np.zeros(len(missing), bool)
        if WHOLE.search(text):
            strings = text.split(" ")
            odd[:] = [WHOLE.search(s) is not None for s in strings]
            text = " ".join([s for s, o in zip(strings, odd.tolist(), strict=True) if not o])
            rows = self.whole([s for s, o in zip(strings, odd.tolist(), strict=True) if o])
        else:
            rows = no_rows()
        if not odd.all():
            rows = self.cut(text, len(missing) - len(rows)).plus(rows)
        order = np.empty(len(missing), np.int64)
        order[np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])] = np.arange(len(missing))
        return rows.take(order)

    def cut(self, text: str, n: int) -> Rows:
        """Ids of n words with a space between each two, from those of their pieces."""
        raw = unicodedata.normalize("NFC", text).lower()
        points = np.frombuffer(raw.encode("utf-32-le"), np.uint32)
        first, space = piece_starts(points)
        size = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800)
        at, data = starts(size)[np.append(first, len(points))], raw.encode()
        spelt = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(at), pa.py_buffer(data))
        coded = spelt.filter(pa.array(~space)).dictionary_encode()
        got = self.pieces.look_up(coded.dictionary.to_pylist(), self.joined).take(coded.indices.to_numpy())
        return Rows(got.ids, np.bincount(np.cumsum(space)[~space], np.diff(got.at), n).astype(np.int64))


def encoder(path: str) -> WordIds:
    """This worker's WordIds for the vocabulary."""
    return common.kept(("ids", path), lambda: WordIds(path))


def chunks(texts: pa.Array) -> Iterator[pa.Array]:
    """Parts of about CHUNK_BYTES, or of one text."""
    sizes = starts(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + CHUNK_BYTES, "right")) - 1)
        yield texts.slice(at, end - at)
        at = end


def encode_rows(texts: pa.Array, ids: WordIds, end_id: int) -> Iterator[Rows]:
    """The ids of the texts (null: none), each text's with end_id behind them, chunk by chunk."""
    for part in chunks(texts):
        split = pc.ascii_split_whitespace(part.view(pa.large_string() if pa.types.is_large_binary(part.type) else pa.string()))
        coded = split.flatten().dictionary_encode()
        known = ids.words.look_up(coded.dictionary.view(pa.large_binary() if pa.types.is_large_string(coded.dictionary.type) else pa.binary()).to_pylist(), ids.find)
        codes = coded.indices.to_numpy()
        bounds = starts(pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False))
        at = starts(np.diff(known.at)[codes])[bounds]
        flat = np.concatenate([known.take(codes[i : i + CHUNK_WORDS]).ids for i in range(0, len(codes), CHUNK_WORDS)]) if len(codes) else np.empty(0, np.uint32)
        yield Rows(np.insert(flat, at[1:], np.uint32(end_id)), np.diff(at) + 1)


def encode_texts(texts: pa.Array | list[bytes | None], ids: WordIds, end_id: int) -> list[bytes]:
    """For each text its ids and end_id, as little-endian uint32 bytes."""
    out = []
    for rows in encode_rows(pa.array(texts, pa.binary()) if isinstance(texts, list) else texts, ids, end_id):
        raw, at = rows.ids.astype("<u4", copy=False).tobytes(), (4 * rows.at).tolist()
        out += [raw[a:b] for a, b in zip(at, at[1:])]
    return out


def binary_rows(rows: Rows, kind: str) -> pa.Array:
    """The rows as a binary array of little-endian numbers."""
    data = rows.ids.astype(kind, copy=False)
    if data.nbytes < 1 << 31:
        return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((rows.at * data.itemsize).astype(np.int32)), pa.py_buffer(data)])
    return pa.array([data[a:b].tobytes() for a, b in zip(rows.at, rows.at[1:], strict=False)], pa.binary())
