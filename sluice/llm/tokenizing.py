"""Whole texts to token ids, exactly as the tokenizer's own library gives them, at a cost per distinct word.

For tokenizers whose text steps never look across ASCII white space (:func:`splits_at_spaces`),
the ids of a text are the ids of its space-free chunks, one after the other.  Chunks are encoded
once and kept in a bounded table of the worker; beyond the bound, new chunks are encoded again in
each batch.  Other tokenizers encode whole texts.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np

#: Chunks that a worker keeps; each takes about 200 bytes.
KEPT_CHUNKS = 200_000

_SPACES = " \t\n\r\x0b\x0c"
_CHUNK = re.compile(f"[^{_SPACES}]+")
#: White space to ``str.split`` that is not in _SPACES; texts with it are cut by _CHUNK.
_OTHER_SPACE = re.compile("[" + "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in _SPACES) + "]")
#: Chunks of printable ASCII and precomposed Latin letters, whose lower case and parts need no Unicode tables.
_PLAIN = re.compile("[!-&(-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_PARTS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")

#: Normaliser and splitter of a lower-casing word BPE, as its file states them (fixed values).
_WORD_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def splits_at_spaces(spec: dict) -> bool:
    """Whether a tokenizer file has exactly the text steps for which chunks are independent."""
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return bool(
        spec.get("model", {}).get("type") == "BPE"
        and (spec.get("normalizer") or {}).get("normalizers") == _WORD_NORMALIZERS
        and len(pre) == 2
        and pre[0].get("pattern") == {"Regex": _WORD_PATTERN}
        and pre[0].get("behavior") == "Removed"
        and pre[0].get("invert") is True
        and pre[1].get("type") == "ByteLevel"
        and not pre[1].get("add_prefix_space")
        and not pre[1].get("use_regex", True)
        and not spec["model"].get("dropout")
        and not spec.get("truncation")
        and not spec.get("padding")
        and all(not set(t["content"]) & set(_SPACES) and not t["lstrip"] and not t["rstrip"] for t in spec.get("added_tokens") or [])
    )


def _byte_letters() -> dict[int, str]:
    """The usual byte-level alphabet: printable bytes stand for themselves, the others follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit blobs, four bytes an id."""

    def __init__(self, path: str, kept: int = KEPT_CHUNKS) -> None:
        self.path, self.kept = path, kept
        self.chunks: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.tokenizer = self.pieces = None
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.by_chunk = False
        else:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            self.by_chunk = splits_at_spaces(spec)
            # A special string of plain characters only would be missed by the fast path.
            self.by_chunk &= all("<" in t["content"] or "'" in t["content"] for t in spec.get("added_tokens") or [])
            self.model = self.tokenizer.model
            self.letters = {c: "".join(_byte_letters()[b] for b in c.encode()) for c in map(chr, range(0xC0, 0x100))}

    def _whole(self, text: str) -> bytes:
        if self.pieces is not None:
            ids = self.pieces.encode(text, add_bos=False, add_eos=False)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        found = self.parts.get(part)
        if found is None:
            level = part if part.isascii() else "".join(self.letters.get(c, c) for c in part)
            found = np.array([t.id for t in self.model.tokenize(level)], "<u4").tobytes()
            if len(self.parts) < self.kept // 2:
                self.parts[part] = found
        return found

    def _chunk(self, chunk: str) -> bytes:
        if _PLAIN.fullmatch(chunk):
            return b"".join(map(self._part, _PARTS.findall(chunk.lower())))
        return self._whole(chunk)

    def blobs(self, texts: list[str | None]) -> list[bytes]:
        """One blob for each text; null counts as empty."""
        if not self.by_chunk:
            return [self._whole(t) if t else b"" for t in texts]
        kept, extra, out = self.chunks, {}, []
        for text in texts:
            if not text:
                out.append(b"")
                continue
            cut = _CHUNK.findall(text) if _OTHER_SPACE.search(text) else text.split()
            try:
                out.append(b"".join(map(kept.__getitem__, cut)))
                continue
            except KeyError:
                pass
            got = []
            for c in cut:
                b = kept.get(c)
                if b is None:
                    b = extra.get(c)
                    if b is None:
                        b = self._chunk(c)
                        if len(kept) < self.kept:
                            kept[c] = b
                        elif len(extra) < self.kept // 10:
                            extra[c] = b
                got.append(b)
            out.append(b"".join(got))
        return out

    def counts(self, texts: list[str | None]) -> list[int]:
        return [len(b) // 4 for b in self.blobs(texts)]


@lru_cache(maxsize=8)
def free_of_spaces(path: str) -> bool:
    """Whether counts of a file's tokenizer do not depend on which ASCII white space parts a text's chunks."""
    if path.endswith(".model"):
        return False
    with open(path, encoding="utf-8") as f:
        return splits_at_spaces(json.load(f))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; it lives as long as the worker."""
    return Encoder(path)


@lru_cache(maxsize=8)
def tokenizer_digest(path: str) -> str:
    """SHA-256 of the tokenizer file: its version."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()
