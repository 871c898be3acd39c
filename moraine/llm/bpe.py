"""Token ids of whole texts as the tokenizers library gives them for a vocabulary file.

For a byte-level BPE with the usual split pattern the ids come from the same vocabulary held as ranks,
with possessive quantifiers in the pattern, which is about four times as fast and gives the same ids (the
tests hold one against the other). Its pattern backtracks in white space only; a long run of white space, which would exhaust
the matcher's stack, is split off before and encoded as the one piece that the pattern would make of it. Any other vocabulary
is encoded by the library that the file is for.
"""

from __future__ import annotations

import json
import re
from array import array

#: The split pattern of byte-level BPE, written without backtracking.
FAST_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: The characters of the Unicode property White_Space, which is what the pattern means by white space.
WHITE_SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_RUN = re.compile(f"(?<![{WHITE_SPACE}])[{WHITE_SPACE}]{{1000,}}")
_ENCODERS: dict[str, "JsonEncoder | PieceEncoder"] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class JsonEncoder:
    """Special strings inside texts become their ids, as is the library's default."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        spec = json.loads(self.tokenizer.to_str())
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
        self.fast = None
        self.special = {t["content"]: array("I", [t["id"]]).tobytes() for t in added}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        if (
            spec["model"]["type"] == "BPE" and spec.get("normalizer") is None and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        ):
            import tiktoken

            back = byte_alphabet()
            ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
            self.fast = tiktoken.Encoding(path, pat_str=FAST_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ordinary(self, text: str) -> list[int]:
        """Ids of a text without special strings. A long run of white space is one piece, but for its last character where more text follows."""
        # a run of 1,000 holds 250 characters from some multiple of 500 on
        if len(text) < 1000 or not any(text[p : p + 250].isspace() for p in range(0, len(text), 500)):
            return self.fast.encode_ordinary(text)
        out, at = [], 0
        for run in LONG_RUN.finditer(text):
            stop = run.end() - (run.end() < len(text))
            out += self.fast.encode_ordinary(text[at : run.start()])
            out += self.fast._encode_single_piece(text[run.start() : stop])
            at = stop
        return out + self.fast.encode_ordinary(text[at:])

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.fast is None:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if not any(s in text for s in self.special):
            return array("I", self.ordinary(text)).tobytes()
        return b"".join(self.special[x] if k % 2 else array("I", self.ordinary(x)).tobytes() for k, x in enumerate(self.cut.split(text)))

    def count(self, text: str) -> int:
        if self.fast is None or any(s in text for s in self.special):
            return len(self.ids(text)) // 4
        return len(self.ordinary(text))


class PieceEncoder:
    """A sentencepiece model, by its library."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, text: str) -> int:
        return len(self.model.encode(text))


def encoder(path: str):
    """The worker's encoder of a vocabulary file, kept between batches and tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path) if path.endswith(".model") else JsonEncoder(path)
    return _ENCODERS[path]
