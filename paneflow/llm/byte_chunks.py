"""Byte-level BPE ids of whole texts through a memo of blank-separated chunks.

The byte-level pattern never joins a character that is no white space with a blank or line feed
after it, and of a run of white space it takes all but the last character as one piece; the last one
leads the next word if it is a blank.  So a text may be cut before every blank and line feed, and
its ids are those of the chunks one after the other, as long as no run is longer than two, no run of
two ends the text, all white space is blank or line feed, and no added token occurs.  Other
texts go through the tokenizer whole.  Each distinct chunk goes through the tokenizer once per task
process; the memo is emptied when it is full.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from paneflow.llm.common import spread

MEMO_CHUNKS = 1_000_000
FIRST = "\0"               # leads the key of a chunk without a blank before it
LINE = "\n"
ALONE = {"": " ", FIRST: "", LINE: LINE}  # keys that cannot share a call with others
#: Latin letters, then marks; the pattern takes the letters as one piece and the marks as another.  An
#: apostrophe may begin a piece with letters in it, and is none of the marks.
LETTERS = r"^[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+"
MARKED = LETTERS + r"[!-&(-/:-@\[-`{-~]+$"
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and c != 39)
#: Runs that cannot be cut, other white space, and characters that count as white space in some libraries.
WHOLE = (r"[ \n]{3}|[ \n]{2}\z|[\x00\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}"
         r"\x{202f}\x{205f}\x{3000}\x{feff}]")


class ByteChunks:
    """Ids of whole texts, without special tokens around them."""

    def __init__(self, path: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task owns one core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values() if x.content]
        (self.line,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.flat, self.begin, self.count = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _add(self, names: list[str], flat: np.ndarray, count: np.ndarray) -> None:
        self.memo.update(zip(names, range(len(self.memo), len(self.memo) + len(names)), strict=True))
        self.count = np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, flat])
        self.begin = np.cumsum(self.count) - self.count

    def learn(self, keys: list[str]) -> None:
        """Many chunks a call, each closed by a line feed, whose id no other chunk has."""
        rest, odd = [x for x in keys if x not in ALONE], [x for x in keys if x in ALONE]
        texts = [x[1:] if x[0] == FIRST else " " + x for x in rest]
        lines = ["\n".join(texts[k:k + 512]) + "\n" for k in range(0, len(texts), 512)]
        got = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        flat = np.concatenate([np.empty(0, np.uint32), *got])
        counts = np.diff(np.flatnonzero(flat == self.line), prepend=-1) - 1
        alone = [np.array(self.tokenizer.encode(ALONE[x], add_special_tokens=False).ids, np.uint32) for x in odd]
        self._add(rest + odd, np.concatenate([flat[flat != self.line], *alone]),
                  np.concatenate([counts, np.array([len(x) for x in alone], np.int64)]))

    def _places(self, keys: list[str], room: bool = True) -> np.ndarray:
        """Places of distinct keys in the memo; new ones are learnt.  With ``room``, a memo that they
        would overfill begins anew with these keys."""
        which = np.fromiter(map(self.memo.get, keys, repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(which < 0)
        if room and self.memo and len(self.memo) + len(new) > MEMO_CHUNKS and len(new):
            self.forget()
            new = np.arange(len(keys))
        if len(new):
            names = [keys[i] for i in new.tolist()]
            self.learn(names)
            which[new] = np.fromiter(map(self.memo.__getitem__, names), np.int64, len(new))
        return which

    def _chunked(self, texts: pa.Array) -> list[np.ndarray]:
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
        each = cut.flatten().dictionary_encode()
        ends = np.concatenate([[0], np.cumsum(cut.value_lengths().to_numpy())])
        codes, n = each.indices.to_numpy().astype(np.int64), len(each.dictionary)
        # the first chunk of a text, a line feed, and what follows one have no blank before them
        line = codes == pc.index(each.dictionary, LINE).as_py()
        bare = np.concatenate([[False], line[:-1]])
        bare[ends[:-1]] = True
        codes[bare & ~line] += n                 # distinct chunks with a blank, then those without
        used = np.flatnonzero(np.bincount(codes, minlength=2 * n))
        # of a word with closing marks the pattern cuts off the marks: fewer distinct words
        marked = pc.match_substring_regex(each.dictionary, MARKED)
        stems = pc.if_else(marked, pc.utf8_rtrim(each.dictionary, MARKS), each.dictionary).dictionary_encode()
        ends_in = pc.replace_substring_regex(each.dictionary.filter(marked), LETTERS, "").dictionary_encode()
        words, marks, m = stems.dictionary.to_pylist(), ["", *ends_in.dictionary.to_pylist()], len(stems.dictionary)
        mark = np.zeros(n, np.int64)
        mark[marked.to_numpy(zero_copy_only=False)] = ends_in.indices.to_numpy() + 1
        stem = stems.indices.to_numpy().astype(np.int64)[used % n] + np.where(used < n, 0, m)
        wanted = np.flatnonzero(np.bincount(stem, minlength=2 * m))
        at = np.zeros(2 * m, np.int64)
        at[wanted] = self._places([words[i] if i < m else FIRST + words[i - m] for i in wanted.tolist()])
        closing = self._places([FIRST + x for x in marks], room=False)   # so that the words keep their places
        # the ids of each distinct chunk side by side, then those of all chunks
        pair = np.stack([at[stem], closing[mark[used % n]]], axis=1).ravel()
        each_count = self.count[pair]
        flat = self.flat[spread(self.begin[pair], each_count)]
        size = each_count.reshape(-1, 2).sum(axis=1)
        sizes, begins = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64)
        sizes[used], begins[used] = size, np.cumsum(size) - size
        count = sizes[codes]
        ids = flat[spread(begins[codes], count)]
        ends = np.concatenate([[0], np.cumsum(count)])[ends]
        return [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; nulls count as empty."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, WHOLE)
        for x in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, x))
        out = self._chunked(pc.if_else(whole, "", texts)) if len(texts) else []
        for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)):
            out[i] = np.concatenate([np.empty(0, np.uint32), *(
                np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, np.uint32) for p in pieces_of(texts[int(i)].as_py()))])
        return out


CUT_CHARS = 1 << 20        # longer texts go through the tokenizer in pieces


def pieces_of(text: str, size: int = CUT_CHARS):
    """A long text in pieces that the tokenizer treats alike on their own: cut before a blank or line
    feed that follows a character that is no white space."""
    import re
    safe = re.compile("(?<=[^\\s\\x1c-\\x1f\\u180e\\u200b\\ufeff])[ \\n]")
    at = 0
    while len(text) - at > size:
        hit = safe.search(text, at + size)
        if not hit:
            break
        yield text[at:hit.start()]
        at = hit.start()
    yield text[at:]
