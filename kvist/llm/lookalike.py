"""Visually identical text with different characters: one plain form, and which values needed it.

Compatibility normalisation and the deletion of what isn't seen come first. Letters that look like a
Latin one are then decided word by word: each such letter has two readings, a Viterbi search takes the
best path of one script through the word's lattice under a character trigram model of the corpus' own
Latin words, so that words wholly in another alphabet stay as they are; only where no path is of one
script does a path win that changes it, at a price for each change.
In an identifier dashes are hyphens besides, and the letter of a section number is read by table alone:
it is one letter, where no word tells its alphabet.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvist.functions.plain import DASHES, LOOKALIKES, blanks, ignorable, variants
from kvist.session import spread, union_all

#: Letters of the trigram model; with the word's border they bound its size to 30 ** 3.
LETTERS = "abcdefghijklmnopqrstuvwxyzæøå"
#: Log-probability of a letter of another alphabet, and of a change of script within a word.
OTHER, CHANGE = math.log(1 / 48), math.log(1e-5)

#: Values without any other character than these are plain already and stay in the JVM; in an identifier an en dash isn't plain.
ORDINARY = r"[^\x00-\x08\x0A-\x7FæøåÆØÅ§«»–•°²³éÉ]"
ORDINARY_IDENTIFIER = ORDINARY.replace("–", "")

_JOINED = regex.compile(r"(\p{Extended_Pictographic}(?:[️\U0001F3FB-\U0001F3FF]|‍(?=\p{Extended_Pictographic})|\p{Extended_Pictographic})*)")
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_LOOKALIKE = frozenset(LOOKALIKES)
#: By script: the letters that Latin ones may stand for in a word of that script.
_FOREIGN: dict[str, dict[str, str]] = {}
for _letter, _latin in LOOKALIKES.items():
    if len(_latin) == 1 and _latin.isascii():
        _FOREIGN.setdefault(unicodedata.name(_letter).split(" ")[0], {}).setdefault(_latin, _letter)
_FOREIGN["CYRILLIC"]["k"] = "к"
_ACCENT = regex.compile(r"(?<=\p{L}\p{M}*)\p{M}")


@lru_cache(maxsize=4096)
def _script(ch: str) -> str:
    """L for Latin, else the first word of the letter's name."""
    name = unicodedata.name(ch, "?").split(" ")[0]
    return "L" if name == "LATIN" else name


def _stood_in(text: str, plain: str) -> bool:
    """Did a letter of another alphabet stand for a Latin one? Both have the same letters at the same places; the reverse is no case."""
    return text != plain and any(a != b and _script(a) != "L" for a, b in zip(text, plain))


def trigram_counts(texts: DataFrame, column: str) -> dict[str, int]:
    """Counts of the letter trigrams of all words of all texts, with '^' for the border; at most 30 ** 3 entries."""
    words = spread(texts.select("_ord", column), "_ord").select(F.explode_outer(F.regexp_extract_all(F.lower(column), F.lit(f"(?U)(?<![\\p{{L}}\\p{{M}}])[{LETTERS}]+(?![\\p{{L}}\\p{{M}}])"), F.lit(0))).alias("w"))
    # explode_outer: an inner one would add a filter that matches each text again.
    words = words.filter("w IS NOT NULL").groupBy("w").agg(F.count("*").alias("n"))
    padded = F.concat(F.lit("^^"), F.col("w"), F.lit("^"))
    # A look-ahead reads all trigrams in one pass; a substring for each would begin at the word's start again.
    grams = words.select("n", F.explode(F.regexp_extract_all(padded, F.lit("(?=(...))"), F.lit(1))).alias("g"))
    return {r["g"]: r["n"] for r in grams.groupBy("g").agg(F.sum("n").alias("n")).collect()}


class Normalizer:
    """Plain forms under a trigram model."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.counts = counts
        self.pairs: dict[str, int] = {}
        for g, n in counts.items():
            self.pairs[g[:2]] = self.pairs.get(g[:2], 0) + n
        self.twos: dict[str, int] = {}
        self.ones: dict[str, int] = {}
        self.after: dict[str, int] = {}
        for g, n in counts.items():
            for held, x in ((self.twos, g[1:]), (self.ones, g[2]), (self.after, g[1])):
                held[x] = held.get(x, 0) + n
        self.total = sum(self.ones.values()) or 1
        self.table = str.maketrans(variants() | dict.fromkeys(ignorable()) | dict.fromkeys(blanks() + "\t", " "))
        self.special = frozenset(map(chr, self.table))
        self.dashes = str.maketrans(dict.fromkeys(DASHES, "-"))
        self.identifier = str.maketrans(dict.fromkeys(DASHES, "-") | LOOKALIKES)
        self.known: dict[str, str] = {}

    def latin(self, a: str, b: str, c: str) -> float:
        """Log-probability of letter c after a and b: trigrams, backed off to pairs, single letters and a floor."""
        p = 0.05 / 30 + 0.15 * self.ones.get(c, 0) / self.total + 0.3 * self.twos.get(b + c, 0) / (self.after.get(b, 0) or 1)
        return math.log(p + 0.5 * self.counts.get(a + b + c, 0) / (self.pairs.get(a + b, 0) or 1))

    def word(self, word: str) -> str:
        """The best reading of a word with letters of other alphabets."""
        if len(word) == 1 and "α" <= word <= "ω" and word != "ο":
            return word  # a lone small Greek letter is a symbol
        if len(word) == 1:
            latin = LOOKALIKES[word]
            return latin if f"^{latin.lower()}^" in self.counts else word
        if word in self.known:
            return self.known[word]
        best = self.search(word)
        if len(self.known) < 100_000:
            self.known[word] = best
        return best

    def search(self, word: str) -> str:
        """Viterbi over the word's lattice: a letter may be read as it stands or as its look-alike of the other script.

        Paths of one script come first: a path that changes script counts only where none of one script exists.
        Latin letters may stand for foreign ones only where the word can't be wholly Latin.
        """
        foreign = {_script(ch) for ch in word if ch not in LOOKALIKES and unicodedata.category(ch)[0] != "M"} - {"L"}
        paths: dict[tuple[str, str, str, bool], tuple[float, str]] = {("^", "^", "", False): (0.0, "")}
        for ch in word:
            readings = [ch, LOOKALIKES[ch]] if ch in LOOKALIKES else [ch, *(_FOREIGN[s][ch] for s in sorted(foreign & _FOREIGN.keys()) if ch in _FOREIGN[s])]
            after: dict[tuple[str, str, str, bool], tuple[float, str]] = {}
            for (a, b, script, mixed), (score, text) in paths.items():
                for r in readings:
                    own = script if unicodedata.category(r[0])[0] == "M" else _script(r[0])
                    x = r[-1].lower() if own == "L" else "?"
                    change = bool(script) and own != script
                    s = score + (self.latin(a, b, x) if own == "L" else OTHER) + (CHANGE if change else 0.0)
                    key = (b, x, own, mixed or change)
                    if key not in after or s > after[key][0]:
                        after[key] = (s, text + r)
            paths = after
        ends = {p: s + (self.latin(p[0], p[1], "^") if p[2] == "L" else OTHER / 4) for p, (s, _) in paths.items()}
        return paths[max(ends, key=lambda p: (not p[3], ends[p]))][1]

    def words(self, text: str) -> str:
        """The text with the best reading of each word that holds a look-alike letter."""
        if _LOOKALIKE.isdisjoint(text):
            return text
        return _WORD.sub(lambda m: m[0] if _LOOKALIKE.isdisjoint(m[0]) else self.word(m[0]), text)

    def plain(self, text: str, identifier: bool) -> tuple[str, bool]:
        """(plain form, whether the value held a character that isn't plain)."""
        clear = text
        if not self.special.isdisjoint(text):
            parts = _JOINED.split(text)
            parts[::2] = [p.translate(self.table) for p in parts[::2]]
            clear = "".join(parts)
        out = unicodedata.normalize("NFC", clear)
        case = out != text or bool(_ACCENT.search(out))
        if identifier:
            plain = out.translate(self.identifier)
            m = regex.fullmatch(r"\s*(?:§\s*)*(\d{1,2})\s*-\s*(\d{1,2})\s*([a-zA-Z]?)\s*", plain)
            if m:
                return f"§ {m[1]}-{m[2]}{m[3]}", case or plain != out
            dashed = out.translate(self.dashes)
            plain = self.words(dashed)
            return " ".join(plain.split()), case or dashed != out or _stood_in(dashed, plain)
        plain = self.words(out)
        return plain.replace("\r\n", "\n").replace("\r", "\n").strip(), case or _stood_in(out, plain)


def plain_values(values: DataFrame, counts: dict[str, int], cases_only: bool) -> DataFrame:
    """(item_table, item_ord, item_field, entry, plain, is_case) of values (.., identifier boolean, value string).

    With cases_only just the values that held something not plain. Null values stay null and are no
    case. Values of ordinary characters only never leave the JVM if cases_only. No shuffle.
    """
    odd = F.when(F.col("identifier"), F.col("value").rlike(ORDINARY_IDENTIFIER)).otherwise(F.col("value").rlike(ORDINARY))
    rows = values.filter(odd) if cases_only else values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = Normalizer(counts)
        for batch in batches:
            done = [n.plain(v, i) if v is not None else (None, False) for i, v in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())]
            plain, case = pa.array([p for p, _ in done], pa.string()), pa.array([c for _, c in done], pa.bool_())
            out = pa.RecordBatch.from_arrays([*batch.columns[:4], plain, case], names=["item_table", "item_ord", "item_field", "entry", "plain", "is_case"])
            yield out.filter(case) if cases_only else out

    return rows.mapInArrow(run, "item_table string, item_ord bigint, item_field string, entry int, plain string, is_case boolean")


def values_of(df: DataFrame, table_name: str, field: str, identifier: bool, order: str = "_ord") -> DataFrame:
    """The values of a string field, or the entries of an array field, in the form that plain_values takes."""
    is_array = df.schema[field].dataType.typeName() == "array"
    entry: list[Column] = [F.posexplode(field).alias("entry", "value")] if is_array else [F.lit(0).alias("entry"), F.col(field).alias("value")]
    rows = df.select(F.lit(table_name).alias("item_table"), F.col(order).cast("long").alias("item_ord"), F.lit(field).alias("item_field"), F.lit(identifier).alias("identifier"), *entry)
    return rows.select("item_table", "item_ord", "item_field", "entry", "identifier", "value")


def look_alike_cases(provisions: DataFrame, questions: DataFrame) -> DataFrame:
    """(item_table, item_ord, item_field) of the values that are made of other characters than they look like."""
    cases = plain_values(_corpus_values(provisions, questions), trigram_counts(provisions, "reg_text"), cases_only=True)
    return cases.select("item_table", "item_ord", "item_field").distinct()  # an array has several entries; cases are few


def plain_corpus(provisions: DataFrame, questions: DataFrame) -> DataFrame:
    """Every value of the three fields in its plain form; array entries by position."""
    return plain_values(_corpus_values(provisions, questions), trigram_counts(provisions, "reg_text"), cases_only=False)


def _corpus_values(provisions: DataFrame, questions: DataFrame) -> DataFrame:
    return union_all([
        values_of(provisions, "tek17_dibk", "section_id", True), values_of(provisions, "tek17_dibk", "reg_text", False),
        values_of(questions, "tek17_eval_questions", "target_sections", True),
    ])
