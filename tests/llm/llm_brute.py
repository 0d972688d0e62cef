"""What tests compare with, written plainly."""

import re


def words(text):
    """Words of the contract: runs outside [\\x20\\x09-\\x0D], A-Z in lower case."""
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
