"""One consistent form for text that looks the same.

A mapping is compiled from the character database and from lists of look-alikes: every character, composed letter, and letter with one mark
that has another form than itself, with that form. It is closed (forms are forms of themselves), checked for conflicts, and turned into an
automaton that finds its longest matches from left to right. Plain stretches pass; a stretch beyond ASCII is matched once, its output composed,
and remembered. Nothing is mapped that the table does not hold.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of several scripts, and the Latin (or, without one, the Greek) letters of the same shape.
CYRILLIC = "А В Е К М Н О Р С Т У Х Ѕ І Ј Ԛ Ԝ Ү Ӏ Г П Ф а е о р с у х ѕ і ј ԁ ԛ ԝ һ ӏ ѵ"
CYRILLIC_AS = "A B E K M H O P C T Y X S I J Q W Y I Γ Π Φ a e o p c y x s i j d q w h l v"
GREEK = "Α Β Ε Ζ Η Ι Κ Μ Ν Ο Ρ Τ Υ Χ Ϲ Ϳ ο ν ϲ ϳ"
GREEK_AS = "A B E Z H I K M N O P T Y X C J o v c j"
ARMENIAN = "Լ Ս Օ զ հ յ ո ս ց օ"
ARMENIAN_AS = "L U O q h j n u g o"
COPTIC = "Ⲅ Ⲏ Ⲓ Ⲕ Ⲙ Ⲛ Ⲟ Ⲡ Ⲣ Ⲥ Ⲧ Ⲩ Ⲭ ⲟ ⲣ ⲥ"
COPTIC_AS = "Γ H I K M N O Π P C T Y X o p c"
CHEROKEE = "Ꭰ Ꭱ Ꭲ Ꭵ Ꭺ Ꭻ Ꭼ Ꮃ Ꮇ Ꮋ Ꮐ Ꮓ Ꮩ Ꮪ Ꮮ Ꮯ Ꮲ Ꮶ Ᏼ"
CHEROKEE_AS = "D R T i A J E W M H G Z V S L C P K B"
LISU = "ꓐ ꓑ ꓓ ꓔ ꓖ ꓗ ꓙ ꓚ ꓜ ꓝ ꓟ ꓠ ꓡ ꓢ ꓣ ꓦ ꓧ ꓪ ꓫ ꓬ ꓮ ꓰ ꓲ ꓳ ꓴ"
LISU_AS = "B P D T G K J C Z F M N L S R V H W X Y A E I O U"
SCRIPTS = ((CYRILLIC, CYRILLIC_AS), (GREEK, GREEK_AS), (ARMENIAN, ARMENIAN_AS), (COPTIC, COPTIC_AS), (CHEROKEE, CHEROKEE_AS), (LISU, LISU_AS))
# Invisible characters that are neither format nor control characters (joiners, fillers, variation selectors).
UNSEEN_RANGES = [(0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x2065, 0x2065), (0xFE00, 0xFE0F), (0xE0100, 0xE01EF)]
# Format characters that do show, or that turn the order of what follows.
SEEN_FORMATS = [*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD, 0x202D, 0x202E]
# Hyphens and quotes of one shape.
SIGNS = {"‐": "-", "‑": "-", ";": ";", "·": "·"}

#: Control characters of ASCII without tab and line feed; carriage returns are line ends. Anything beyond ASCII.
CONTROLS = re.compile(r"[\x00-\x08\x0b-\x1f\x7f]")
BEYOND = re.compile(r"([^\x00-\x7f]+)")


def look_alikes() -> dict[str, str]:
    """Letters to the letter of the same shape, checked: no letter maps two ways, no target is itself mapped."""
    out: dict[str, str] = {}
    for many, targets in SCRIPTS:
        for a, b in zip(many.split(), targets.split(), strict=True):
            if a != b and out.setdefault(a, b) != b:
                raise ValueError(f"{a!r} maps both to {out[a]!r} and {b!r}")
    out |= SIGNS
    if clash := set(out) & set("".join(out.values())):
        raise ValueError(f"targets that are mapped themselves: {clash}")
    return out


def unseen(ch: str) -> bool:
    """Whether a character shows nothing: format and control characters, fillers and selectors; not tab and line feed."""
    c = ord(ch)
    if c < 0x80:
        return (c < 0x20 and ch not in "\t\n") or c == 0x7F
    return (unicodedata.category(ch) in ("Cf", "Cc") and c not in SEEN_FORMATS and c != 0x85) or any(a <= c <= b for a, b in UNSEEN_RANGES)


def folded(ch: str) -> str:
    """One decomposed character without its width, joined letters apart; anything else as it is."""
    kind, _, code = unicodedata.decomposition(ch).partition(" ")
    if unicodedata.category(ch) == "Zs":
        return " "
    if not kind.startswith("<"):
        return ch
    parts = "".join(chr(int(x, 16)) for x in code.split())
    if kind in ("<wide>", "<narrow>"):
        return parts
    letters = all(unicodedata.category(p) in ("Lu", "Ll", "Lt", "Lo", "Mn") for p in parts)
    if kind == "<compat>" and unicodedata.category(ch)[0] == "L" and len(parts) > 1 and letters:
        return parts
    return ch


def formed(text: str, alike: dict[str, str]) -> str:
    """The form of one character or cluster, by its definition: unseen characters dropped, decomposed, freed of width, look-alikes mapped, composed."""
    text = "".join(ch for ch in text if not unseen(ch))
    text = "".join(map(folded, unicodedata.normalize("NFD", text)))
    return unicodedata.normalize("NFC", "".join(alike.get(ch, ch) for ch in unicodedata.normalize("NFD", text)))


def compiled_mapping() -> tuple[dict[str, str], list[int]]:
    """All single characters beyond ASCII, and all letters with a mark, that have another form than themselves; and the characters that follow in a cluster.

    Checked: forms are forms of themselves, and a letter with a mark has the form that its parts' forms compose to, so that no two matches contradict
    each other whichever of them is the longest.
    """
    alike, out, follow = look_alikes(), {"\r\n": "\n", "\r": "\n"}, []
    composed: list[str] = []
    twins: dict[str, list[str]] = {}
    for c in range(0x80, sys.maxunicode + 1):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind in ("Cn", "Co", "Cs") and not unseen(ch) or 0xAC00 <= c < 0xD7A4:
            continue
        hidden = unseen(ch)
        # Half-width voicing marks are letters by their category, and marks once their width is gone.
        if kind in ("Mn", "Mc", "Me") or hidden or c in (0xFF9E, 0xFF9F):
            follow.append(c)
        parts = unicodedata.decomposition(ch)
        if not (parts or hidden or kind == "Zs" or ch in alike):
            continue
        form = formed(ch, alike)
        if form != ch:
            out[ch] = form
            if len(form) == 1:
                twins.setdefault(form, []).append(ch)
        if parts and not parts.startswith("<"):
            composed.append(ch)
    for ch in composed:
        base, *marks = unicodedata.normalize("NFD", ch)
        for b in (base, *twins.get(base, ())):
            key = "".join((b, *marks))
            out[key] = formed(key, alike)
    for key, form in out.items():
        if formed(form, alike) != form and form != "\n":
            raise ValueError(f"the form of {key!r} has another form")
        if key[0] != "\r" and unicodedata.normalize("NFC", "".join(out.get(ch, ch) for ch in key)) != form:
            raise ValueError(f"{key!r} and its parts have different forms")
    return out, follow


class Transducer:
    """The compiled mapping; call it with a text."""

    #: Stretches beyond ASCII that are remembered, and their greatest length: for speed only.
    REMEMBERED, LONGEST = 200_000, 24

    def __init__(self) -> None:
        import ahocorasick

        self.table, follow = compiled_mapping()
        self.follows = re.compile(f"[{_class(follow)}]")
        self.automaton = ahocorasick.Automaton()
        for key, form in self.table.items():
            self.automaton.add_word(key, (len(key), form))
        self.automaton.make_automaton()
        self.known: dict[str, str] = {}

    def _run(self, run: str) -> str:
        """A stretch of characters beyond ASCII, with the one before it where marks follow that: longest matches from the left, composed."""
        out = self.known.get(run)
        if out is None:
            parts, at = [], 0
            for end, (n, form) in self.automaton.iter_long(run):
                parts += (run[at : end + 1 - n], form)
                at = end + 1
            out = unicodedata.normalize("NFC", "".join(parts) + run[at:])
            if len(self.known) < self.REMEMBERED and len(run) <= self.LONGEST:
                self.known[run] = out
        return out

    def __call__(self, text: str) -> str:
        if CONTROLS.search(text):
            text = CONTROLS.sub("", text.replace("\r\n", "\n").replace("\r", "\n"))
        if text.isascii():
            return text
        out = []
        parts = BEYOND.split(text)
        for i in range(1, len(parts), 2):
            before, run = parts[i - 1], parts[i]
            if before and self.follows.match(run):
                before, run = before[:-1], before[-1] + run
            out += (before, self._run(run))
        return "".join(out) + parts[-1]


def _class(codes: list[int]) -> str:
    out, start, last = [], codes[0], codes[0]
    for c in [*codes[1:], -1]:
        if c != last + 1:
            out.append(f"\\U{start:08x}-\\U{last:08x}")
            start = c
        last = c
    return "".join(out)


@cache
def transducer() -> Transducer:
    return Transducer()


def canonical_text(text: str | None) -> str | None:
    """The consistent form of one text; null stays null. Applying it twice changes nothing more."""
    return None if text is None else transducer()(text)


def _digests(make: Callable[[str], str], key: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = lambda t: hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for b in batches:
            raw = [digest(t) for t in b["text"]]
            form = [r if (c := make(t)) == t else digest(c) for t, r in zip(b["text"], raw)]
            yield pd.DataFrame({key: b[key], "form": form, "raw": raw})

    return rows


def text_forms(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key`, `form`, `raw`: 128-bit digests of the consistent form and of the text as it is. Null texts have no form and no row."""
    kind = documents.schema[key].dataType.simpleString()
    make = canonical_text
    return documents.where(F.col(text).isNotNull()).select(F.col(key), F.col(text).alias("text")).mapInPandas(_digests(make, key), f"{key} {kind}, form binary, raw binary")


def same_look_classes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: `key`, `class_id` (the least key of those that look the same), `members`, `variants` (different texts among them)."""
    forms = text_forms(documents, key, text)
    per_text = forms.groupBy("form", "raw").agg(F.min(key).alias("_least"), F.count("*").alias("_n"))
    classes = per_text.groupBy("form").agg(F.min("_least").alias("class_id"), F.sum("_n").alias("members"), F.count("*").alias("variants"))
    return forms.join(classes, "form").select(key, "class_id", "members", "variants")


def same_look_pairs(forms: DataFrame, key: str = "doc_id") -> DataFrame:
    """`doc_a` < `doc_b`: pairs with one form and different texts, from `text_forms`.

    Forms with at least two different texts are found on counts alone; only their documents go on, and only pairs of different
    texts are joined, so the pairs made are the pairs returned, and a class of exact copies makes none among itself.
    """
    per_text = forms.select("form", "raw").groupBy("form", "raw").count().drop("count")
    mixed = per_text.join(per_text.groupBy("form").count().where("count > 1").select("form"), "form", "left_semi")
    a = mixed.select("form", F.col("raw").alias("raw_a"))
    b = mixed.select("form", F.col("raw").alias("raw_b"))
    ordered = a.join(b, "form").where("raw_a < raw_b")
    one = forms.select("form", F.col("raw").alias("raw_a"), F.col(key).alias("_x"))
    two = forms.select(F.col("form"), F.col("raw").alias("raw_b"), F.col(key).alias("_y"))
    met = ordered.join(one, ["form", "raw_a"]).join(two, ["form", "raw_b"])
    return met.where("_x <> _y").select(F.least("_x", "_y").alias("doc_a"), F.greatest("_x", "_y").alias("doc_b")).distinct()
