"""Token ids of whole texts from the tokenizers library, with a memo of space-led pieces.

The byte-level pre-tokenizer splits a text in the same places whether or not it is first cut
at single spaces between two non-spaces: no token runs across such a place but the one that
begins with the space. So a text's ids are those of its pieces, and a piece that was seen
before costs one dict lookup. Tokenizers of another kind encode whole texts.
"""

from __future__ import annotations

import json
import re
from array import array

#: Most pieces that are remembered, and letters of a piece of several runs that still is.
MEMO, SHORT = 900_000, 14
#: Characters of one slice of a long text.
SLICE = 1 << 20
#: Pieces of these characters fall apart into runs of letters, of digits, of signs and single
#: line ends, whatever stands around them; an apostrophe may start a contraction.
_plain = re.compile(r"(\0?)(?:[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:-@\[-`{-~]|\n(?!\n))+")
_runs = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+|\n")
_odd = re.compile(r"\s\s")
_safe = re.compile(r"(?<=\S) (?=\S)")
_open: dict = {}


def _visible() -> dict[int, str]:
    """The printable characters that byte-level models use for bytes: those that are printable
    stand for themselves, the others follow from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return {b: chr(b if b in own else next(rest)) for b in range(256)}


_byte = _visible()
_chars = {c: "".join(_byte[b] for b in c.encode()) for c in map(chr, [*range(0x20, 0x7F), 0x0A, *range(0xC0, 0x100)])}


class Memo(dict):
    """Ids of what follows a space, and, with a zero byte before it, of what begins a text."""

    def __init__(self, tok):
        self.tok, self.model = tok, tok.model.tokenize

    def __missing__(self, y: str) -> bytes:
        lead = y[:1] == "\0"
        core = y[1:] if lead else y
        if core.isalpha() and core.isascii():
            out = self._run(core if lead else f"Ġ{core}")
        elif _plain.fullmatch(y):
            r = _runs.findall(core)
            if len(r) == 1:
                shown = core if core.isascii() and core != "\n" else "".join(map(_chars.__getitem__, core))
                out = self._run(shown if lead else f"Ġ{shown}")
            else:
                out = self[f"\0{r[0]}" if lead else r[0]] + b"".join([self[f"\0{x}"] for x in r[1:]])
                if len(y) > SHORT:
                    return out
        else:
            out = array("I", self.tok.encode(core if lead else f" {core}", add_special_tokens=False).ids).tobytes()
        self[y] = out
        return out

    def _run(self, shown: str) -> bytes:
        """Ids of one run of letters, digits, signs or line ends, straight from the model."""
        return array("I", [t.id for t in self.model(shown)]).tobytes()


class Encoder:
    """The ids that the library gives with add_special_tokens=False; strings of added tokens
    inside a text are those tokens, as in a tokenizer fresh from its file."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.cuts = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        #: Texts with one of these go to the library whole.
        self.special = ["\0", *(t["content"] for t in spec.get("added_tokens") or [])]
        self.memo = Memo(self.tok)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _slices(self, text: str):
        at = 0
        while len(text) - at > 2 * SLICE and (m := _safe.search(text, at + SLICE)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def _cut(self, text: str) -> bytes:
        out = []
        for k, s in enumerate(self._slices(text)):
            whole = s[1:] if k else s  # a later slice begins with its space
            x = _safe.split(whole) if _odd.search(whole) or whole[:1] == " " or whole[-1:] == " " else whole.split(" ")
            if not k:
                x[0] = f"\0{x[0]}"
            out.append(b"".join(map(self.memo.__getitem__, x)))
            if len(self.memo) > MEMO:
                self.memo.clear()
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not self.cuts:
            return self._ids(texts)
        return [self._ids([t])[0] if any(x in t for x in self.special) else self._cut(t) for t in texts]


def encoder(path: str) -> Encoder:
    """One encoder for each process."""
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]
