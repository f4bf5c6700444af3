"""Token counts by overlap resynchronisation, and the encoders they share.

``PieceEncoder`` encodes texts with the ``tokenizers`` library and remembers
the result for each piece between proven boundaries; ``resync_count`` encodes
huge texts in overlapping chunks with offsets.
"""

from __future__ import annotations

import os
import re
from itertools import chain

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from thalweg.llm.common import keeps, map_arrow, text_rows

#: White space of any kind other than the plain space and line feed, and format characters near it.
#: A superset of what the libraries call white space: a text that holds one is encoded as a whole.
ODD_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁯　﻿]")
_GAP = re.compile(r"(?<=[^\s\x1c-\x1f\x85\xa0᠎​-‏﻿])[ \n]")
#: One word of unaccented or Latin-1 letters, perhaps after one space: every such letter is a letter to the pre-tokenisers.
_WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Class of each byte: 1 space or line feed, 2 plain stop, 3 ASCII letter, 4 first and 6 second byte of a Latin-1 letter,
#: 5 one with which an odd space may begin. Both byte-level pre-tokenisers cut between a letter and a stop.
_CLASS = bytes(
    1 if b in b" \n" else 2 if b in b".,;:!?" else 3 if chr(b).isalpha() and b < 0x80 else 4 if b == 0xC3 else 5 if b in b"\t\x0b\x0c\r\x1c\x1d\x1e\x1f\xc2\xe1\xe2\xe3\xef" else 6 if 0x80 <= b < 0xC0 and b not in b"\x97\xb7" else 0
    for b in range(256)
)
_LATIN = "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
_LOADED: dict[str, object] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    if path not in _LOADED:
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


class PieceEncoder:
    """Encodes pieces of text and keeps what it found: the pieces and their ids stand in arrays of bounded size.

    Words go to the library's model directly, other pieces are joined by the
    library's own end-of-text token, which it takes out of a text before
    anything else, so that each piece is encoded as if it stood alone; pieces
    that hold that string themselves are encoded singly. With ``strip`` the
    spaces and line feeds around a piece are left out. Past ``keep`` pieces the
    older half is forgotten.
    """

    def __init__(self, path: str, separator: str = "<|endoftext|>", keep: int = 600_000, strip: bool = False):
        self.tokenizer = load(path)
        self.separator, self.sep_id = separator, self.tokenizer.token_to_id(separator)
        self.keep, self.strip = keep, strip
        self.kind = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() <= 65536 else np.uint32)
        from tokenizers import pre_tokenizers

        alone = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes = {ord(c): alone.pre_tokenize_str(c)[0][0] for c in _LATIN + " "}
        self.lower = "Lowercase" in str(self.tokenizer.normalizer)
        self.known = pa.array([], pa.string())
        self.ids, self.ends = np.zeros(0, self.kind), np.zeros(1, np.int64)

    def _encode(self, pieces: list[str]) -> list[list[int]]:
        tokenize, table, match, lower, separator = self.tokenizer.model.tokenize, self.bytes, _WORD.fullmatch, self.lower, self.separator
        out, plain = [], []
        for k, p in enumerate(pieces):
            if match(p):
                t = p.lower() if lower else p
                out.append([x.id for x in tokenize(t.translate(table) if p[0] == " " or not t.isascii() else t)])
            else:
                if separator in p:
                    out.append(self.tokenizer.encode(p, add_special_tokens=False).ids)
                else:
                    out.append([])
                    plain.append(k)
        for at in range(0, len(plain), 512):
            part = plain[at : at + 512]
            ids = self.tokenizer.encode(separator.join([pieces[k] for k in part]), add_special_tokens=False).ids
            begin = 0
            for k in part[:-1]:
                end = ids.index(self.sep_id, begin)
                out[k] = ids[begin:end]
                begin = end + 1
            out[part[-1]] = ids[begin:]
        return out

    def places(self, pieces: pa.StringArray) -> np.ndarray:
        """For each of the (distinct) pieces its place among the known ones; what is not known is learnt."""
        at = np.full(len(pieces), -1, np.int64)
        if len(self.known):
            at = pc.fill_null(pc.index_in(pieces, value_set=self.known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new) and len(self.known) and len(self.known) + len(new) > self.keep:
            gone = -(-len(self.known) // 2)
            self.known = pa.concat_arrays([self.known.slice(gone)])
            self.ids, self.ends = self.ids[self.ends[gone] :].copy(), self.ends[gone:] - self.ends[gone]
            return self.places(pieces)
        if len(new):
            learnt = pieces.take(pa.array(new))
            texts = learnt.to_pylist()
            found = self._encode([t.strip(" \n") for t in texts] if self.strip else texts)
            at[new] = len(self.known) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, learnt])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), self.kind)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(x) for x in found])])
        return at


def pieces_of(texts: pa.StringArray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The texts cut before each run of spaces or line feeds that follows another character, and between letter and stop.

    Gives the pieces of all texts in a row, dictionary-encoded, the place of
    each text's first piece (one more than there are texts) and the places of
    the texts that may hold an odd space. The cuts are ASCII, so the pieces
    share the texts' buffer.
    """
    texts = texts.fill_null("") if texts.null_count else texts
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int32, n + 1, 4 * texts.offset)
    size = int(ends[-1] - ends[0])
    if not size:
        return pa.array([], pa.string()).dictionary_encode(), np.zeros(n + 1, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8, size, int(ends[0]))
    ends = ends - ends[0]
    kind = np.frombuffer(data.tobytes().translate(_CLASS), np.uint8)
    space, stop = kind == 1, kind == 2
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut[1:] |= stop[1:] & (kind[:-1] == 3)
    cut[2:] |= stop[2:] & (kind[1:-1] == 6) & (kind[:-2] == 4)
    cut[ends[:-1][ends[:-1] < ends[1:]]] = True
    at = np.flatnonzero(cut)
    first = np.searchsorted(at, ends)
    pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.append(at, size).astype(np.int32)), pa.py_buffer(data))
    odd = np.unique(np.searchsorted(ends, np.flatnonzero(kind == 5), side="right") - 1)
    return pieces.dictionary_encode(), first, odd


def direct_counts(texts: pa.StringArray, encoder: PieceEncoder) -> np.ndarray:
    """Tokens of texts that are not huge.

    A place before a run of spaces or line feeds that follows another
    character, or between a letter and a stop, is always a boundary of the
    byte-level pre-tokeniser, whatever stands around it, so the pieces between
    such places are encoded apart, each distinct one once. A text with an odd space is encoded as a whole.
    """
    pieces, first, odd = pieces_of(texts)
    at = encoder.places(pieces.dictionary)
    each = encoder.ends[at + 1] - encoder.ends[at]
    total = np.concatenate([[0], np.cumsum(each[pieces.indices.to_numpy()])])
    out = total[first[1:]] - total[first[:-1]]
    for k in odd.tolist():
        text = texts[k].as_py()
        if ODD_SPACE.search(text):
            out[k] = len(encoder.tokenizer.encode(text, add_special_tokens=False).ids)
    return out


def direct_count(text: str, encoder: PieceEncoder) -> int:
    return int(direct_counts(pa.array([text], pa.string()), encoder)[0])


def resync_count(text: str, tokenizer, chunk: int = 32_768, overlap: int = 512) -> int:
    """Tokens of a huge text from overlapping chunks.

    Each chunk is encoded with offsets. Inside the overlap of two chunks a
    place right before a space or line feed that follows another character is
    looked for, nearest to the middle, at which both encodings end a token: a
    byte-level pre-tokeniser cuts there whatever precedes or follows, so what
    is left of it in the first and right of it in the second is what one
    encoding of the whole gives. Without such a place the overlap doubles, at
    last to the rest of the text.
    """
    total, start, begin = 0, 0, 0  # start: of the chunk; begin: the place up to which tokens are counted
    n = len(text)
    end = min(n, start + chunk)
    first = tokenizer.encode(text[start:end], add_special_tokens=False).offsets
    while end < n:
        width = overlap
        while True:
            lap = max(begin, end - width)
            places = [lap + 1 + m.start() for m in _GAP.finditer(text[lap + 1 : end])] if lap + 1 < end else []
            middle = (lap + end) // 2
            ends = {b + start for _, b in first}
            places = sorted((p for p in places if p in ends), key=lambda p: abs(p - middle))[:8]
            if places:
                stop = min(n, lap + chunk)
                if stop <= end:
                    stop = min(n, end + chunk)
                second = tokenizer.encode(text[lap:stop], add_special_tokens=False).offsets
                known = {b + lap for _, b in second}
                cut = next((p for p in places if p in known), None)
                if cut is not None:
                    break
            if end >= n:
                break
            # alignment failed: the first chunk reaches further and the overlap widens
            width *= 2
            end = min(n, end + width)
            first = tokenizer.encode(text[start:end], add_special_tokens=False).offsets
        if end >= n:
            break
        total += sum(begin < b + start <= cut for _, b in first)
        start, begin, end, first = lap, cut, stop, second
    return total + sum(b + start > begin for _, b in first) + _empty_before(first, start, begin)


def _empty_before(offsets: list[tuple[int, int]], start: int, begin: int) -> int:
    """Tokens with an empty span at the very start of a text, which no comparison of ends counts."""
    return sum(b + start == 0 for _, b in offsets) if begin == 0 else 0


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, huge: int = 32_768, overlap: int = 512) -> DataFrame:
    """Tokens of every whole text under a byte-level BPE of the ``tokenizers`` library.

    Returns doc_id, n_bytes, n_tokens, over_limit (more than ``limit``), one
    row for each input row, repeated rows included. A null or empty text has 0
    bytes and 0 tokens; a null doc_id stays null. Texts of more than ``huge``
    characters are encoded in overlapping chunks (``resync_count``), so memory
    follows the chunk, not the text. There is no shuffle.
    """

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = _encoder(path, strip=False)
        texts = batch.column("text")
        n_bytes = pc.binary_length(texts).cast(pa.int64())
        large = np.flatnonzero(n_bytes.to_numpy() > huge)
        large = [k for k in large.tolist() if len(texts[k].as_py()) > huge]
        some = texts
        if large:
            chosen = np.zeros(len(texts), bool)
            chosen[large] = True
            some = pc.if_else(pa.array(chosen), "", texts)
        n = direct_counts(some, encoder)
        for k in large:
            n[k] = resync_count(texts[k].as_py(), encoder.tokenizer, huge, overlap)
        return pa.record_batch([batch.column("doc_id"), n_bytes, pa.array(n, pa.int64()), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_arrow(text_rows(docs), count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", most_bytes=4 << 20, cache="tokens")


_ENCODERS: dict = {}
keeps("tokens", _ENCODERS.clear)


def _encoder(path: str, strip: bool) -> PieceEncoder:
    if (path, strip) not in _ENCODERS:
        _ENCODERS[path, strip] = PieceEncoder(path, strip=strip)
    return _ENCODERS[path, strip]


def encode_words(texts: pa.StringArray, encoder: PieceEncoder) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row and the number of ids of each, under a vocabulary that drops white space.

    Spaces and line feeds end a word of such a tokeniser and leave no token,
    so the words between them are encoded apart, each distinct one once.
    """
    pieces, first, _ = pieces_of(texts)
    known = encoder.places(pieces.dictionary)
    at = known[pieces.indices.to_numpy()]
    begin, size = encoder.ends[at], encoder.ends[at + 1] - encoder.ends[at]
    total = np.concatenate([[0], np.cumsum(size)])
    ids = encoder.ids[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
    return ids, total[first[1:]] - total[first[:-1]]
