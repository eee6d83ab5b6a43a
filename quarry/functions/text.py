"""Column expressions and small functions on text: identity, titles, tokens, stems."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def docid(hash_: Column) -> Column:
    return F.substring(hash_, 1, 6)


def token_estimate(content: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(content) / 4).cast("long")


def basename(path: Column) -> Column:
    """The last part of a path without its extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def title(content: Column, path: Column) -> Column:
    """The first ``# `` heading, else the file's name. Lines end at ``\\n`` only."""
    found = F.regexp_replace(F.regexp_extract(content, r"(?md)^#\s+(.+)$", 1), r"^[ \t\r\n\x0b\f\u0085 ]+|[ \t\r\n\x0b\f\u0085 ]+$", "")
    return F.when(found != "", found).otherwise(basename(path))


def _accents() -> tuple[str, str]:
    """Letters that lose a mark, and what is left of them, over the Latin, Greek and
    Cyrillic blocks with composed letters."""
    source, target = [], []
    for code in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)):
        bare = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if len(bare) == 1 and bare != chr(code):
            source.append(chr(code))
            target.append(bare)
    return "".join(source), "".join(target)


ACCENTED, BARE = _accents()


def tokens(text: Column) -> Column:
    """Runs of letters, numbers and private-use characters, in lower case, without
    diacritics."""
    ascii_only = F.length(text) == F.octet_length(text)
    plain = F.when(ascii_only, F.lower(text)).otherwise(F.translate(F.lower(text), ACCENTED, BARE))
    return F.regexp_extract_all(plain, F.lit(TOKEN), F.lit(0))


_FOLD = str.maketrans(ACCENTED, BARE)


def tokenize(text: str) -> list[str]:
    """:func:`tokens` on the driver, for queries."""
    out, run = [], ""
    for c in text.lower().translate(_FOLD):
        if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co":
            run += c
        elif run:
            out.append(run)
            run = ""
    return [*out, run] if run else out


# --- Porter's algorithm (M. F. Porter, 1980) ------------------------------------------

_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(word: str) -> str:
    """``c`` or ``v`` for each letter; y counts as a vowel after a consonant."""
    out = ""
    for i, letter in enumerate(word):
        vowel = letter in "aeiou" or (letter == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c", _shape(stem)))


def _closed(stem: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x or y."""
    return len(stem) > 2 and _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def stem(word: str) -> str:
    """The stem of a lower-case token of 3 to 64 bytes; others stay as they are."""
    if not 2 < len(word.encode()) <= 64:
        return word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: len(word) - len(end)] + new
            break
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for end in ("ed", "ing"):
            if word.endswith(end):
                rest = word[: -len(end)]
                if "v" in _shape(rest):
                    word = rest
                    if word.endswith(("at", "bl", "iz")):
                        word += "e"
                    elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                        word = word[:-1]
                    elif _measure(word) == 1 and _closed(word):
                        word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end in sorted(table, key=len, reverse=True):
            if word.endswith(end):
                if _measure(word[: -len(end)]) > 0:
                    word = word[: -len(end)] + table[end]
                break
    for end in sorted(_STEP4, key=len, reverse=True):
        if word.endswith(end):
            rest = word[: -len(end)]
            if _measure(rest) > 1 and (end != "ion" or rest.endswith(("s", "t"))):
                word = rest
            break
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or (_measure(rest) == 1 and not _closed(rest)):
            word = rest
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


# --- structure ---------------------------------------------------------------------


def break_score(line: str) -> int:
    """How good a place this line is to begin a new chunk."""
    line = line.strip()
    for start, score in (("# ", 100), ("## ", 90), ("### ", 80), ("```", 80), ("#### ", 70), ("##### ", 60), ("---", 60), ("***", 60), ("###### ", 50)):
        if line.startswith(start):
            return score
    if not line:
        return 20
    return 5 if line.startswith(("- ", "* ")) or re.match(r"[0-9]+\.\s", line) else 1


def break_score_column(line: Column) -> Column:
    line = F.trim(line, F.lit(" \t\r\n\x0b\x0c"))
    out = F.when(line.startswith("# "), 100).when(line.startswith("## "), 90).when(line.startswith("### ") | line.startswith("```"), 80)
    out = out.when(line.startswith("#### "), 70).when(line.startswith("##### ") | line.startswith("---") | line.startswith("***"), 60)
    out = out.when(line.startswith("###### "), 50).when(line == "", 20)
    return out.when(line.startswith("- ") | line.startswith("* ") | line.rlike(r"^[0-9]+\.\s"), 5).otherwise(1)


# --- names of files ----------------------------------------------------------------


def expand_glob(pattern: str) -> list[str]:
    """The pattern without a leading ``**/``, its first ``{a,b}`` spelt out."""
    pattern = pattern.removeprefix("**/")
    found = re.search(r"\{([^}]*)\}", pattern)
    if not found:
        return [pattern]
    return [pattern[: found.start()] + part.strip() + pattern[found.end() :] for part in found[1].split(",")]


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of one pattern; ``*`` and ``?`` stay within a part."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif close > 0:
            out += "[" + pattern[i + 1 : close].replace("\\", "\\\\") + "]"
            i = close
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def matches_glob(path: str, pattern: str) -> bool:
    """Patterns with a slash look at the whole relative path, others at the name."""
    return any(re.search(glob_regex(p), path if "/" in p else path.rsplit("/", 1)[-1]) for p in expand_glob(pattern))


def like_pattern(pattern: str) -> str:
    """Case-insensitive regular expression for a path pattern: ``*`` and ``%`` stand for
    anything, ``_`` for one character; letters other than A-Z keep their case."""
    out = ""
    for c in pattern:
        out += ".*" if c in "*%" else "." if c == "_" else f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else re.escape(c)
    return f"(?s)^{out}$"
