"""Token ids of whole texts with the tokenizers library, piece by piece and remembered.

A text is cut before each single space or newline between two signs that are not white space. No
pre-token spans such a place and none looks across it, so that encoding the pieces one by one equals
encoding the text, and most pieces have been met before. New pieces of a text are encoded together,
parted by a sign of one known id. A text with other runs of white space, with a separator that only
Python takes for white space, or with the string of one of the tokenizer's added tokens (such as
<|endoftext|>, which the library gives the id of the token) is encoded whole.
"""

from __future__ import annotations

import os
import re
from functools import cache

import numpy as np

ODD = re.compile("[\x1c-\x1f]")
#: Pieces that a Python worker remembers: as many newer ones, and those of before that are met again;
#: about 160 bytes each. The pipeline, whose workers do other work too, remembers FEWER.
REMEMBER = 1_000_000
FEWER = 300_000
HEADS = 20_000


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, remember: int = REMEMBER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = self.tok.get_added_tokens_decoder().values()
        #: Strings that the tokenizer looks for in a text before it cuts it: in the text as it is, and
        #: those that it looks for in the normalised text.
        self.added = [t.content for t in added if not t.normalized]
        self.added_normal = [t.content.casefold() for t in added if t.normalized]
        #: Whether the tokenizer drops white space; then any run of it parts two pieces.
        self.drops = self.direct("a b").tobytes() == self.direct("a \n b").tobytes()
        self.mark, between = ("0", " 0 ") if self.drops else ("\n", "\n")
        self.between = between
        (self.mark_id,) = self.direct(self.mark).tolist()
        self.newline = b"" if self.drops else self.direct("\n").tobytes()
        self.remember = remember
        self.known: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def direct(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def holds_added(self, text: str) -> bool:
        if any(a in text for a in self.added):
            return True
        return bool(self.added_normal) and any(a in text.casefold() for a in self.added_normal)

    def learn(self, pieces: list[str]) -> bool:
        """Encodes new pieces; False where one of them shows that the text can't be cut this way."""
        bodies = []
        for p in pieces:
            if self.drops:
                bodies.append(p)
                continue
            body = p[1:] if p[:1] == "\n" else p
            if not body or body.split() != [body]:
                return False
            bodies.append(body if body is not p else " " + p)
        ids = self.direct(self.between.join(bodies))
        cuts = np.flatnonzero(ids == self.mark_id)
        data = ids.tobytes()
        if len(cuts) == len(bodies) - 1:
            found = [data[4 * s : 4 * e] for s, e in zip([0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)], strict=True)]
        else:  # a piece holds the mark itself
            found = [self.direct(b).tobytes() for b in bodies]
        self.known.update(
            (p, x if self.drops or p[:1] != "\n" else self.newline + x) for p, x in zip(pieces, found, strict=True)
        )
        return True

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if ODD.search(text) or self.holds_added(text):
            return self.direct(text).tobytes()
        if self.drops:
            pieces, head = text.split(), b""
        else:
            first, *pieces = text.replace("\n", " \n").split(" ")
            if not first or first.split() != [first]:
                return self.direct(text).tobytes()
            head = self.heads.get(first)
            if head is None:
                head = self.direct(first).tobytes()
                if len(self.heads) < HEADS:
                    self.heads[first] = head
        out = list(map(self.known.get, pieces))
        if None in out:
            if len(self.known) >= self.remember:
                self.older, self.known = self.known, {}
            new = {p for p, x in zip(pieces, out, strict=True) if x is None}
            again = {p: x for p in new if (x := self.older.get(p)) is not None}
            self.known.update(again)
            if len(again) < len(new) and not self.learn([p for p in new if p not in again]):
                return self.direct(text).tobytes()
            known = self.known
            out = [known[p] if x is None else x for p, x in zip(pieces, out, strict=True)]
        return head + b"".join(out)


@cache
def encoder(path: str, remember: int = REMEMBER) -> Encoder:
    return Encoder(path, remember)
