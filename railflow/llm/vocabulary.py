"""Vocabulary files of public tokenizers; operators take their text, so any other file will do."""

from __future__ import annotations

from pathlib import Path


def word_bpe(path: str | None = None) -> str:
    """Text of the word-end BPE vocabulary (a few MB); by default the installed public file."""
    return _text(path, "word_bpe_49k.json")


def byte_bpe(path: str | None = None) -> str:
    """Text of the byte-level vocabulary whose word-initial pieces begin with a space; by default the installed public file."""
    return _text(path, "byte_bpe_50k.json")


def _text(path: str | None, name: str) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    return Path(path).read_text(encoding="utf-8")
