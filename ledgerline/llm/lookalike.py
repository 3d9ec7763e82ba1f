"""One consistent form for text that looks the same.

Two forms are made of each text. The visible form is a rule per character, applied to canonically decomposed text that is composed
again afterwards: what can't be seen goes; every blank becomes a space and every
hyphen '-'; widths, ligatures and no-break forms take their compatibility
decomposition; letters of other scripts that look like Latin ones become these.
Letter case, accents, raised and lowered digits, other marks and the number of blanks and
lines stay in it, for they can be seen. The folded form is compatibility composition with full case
folding of that: texts that look the same agree in it, so it finds the candidates, whose visible forms part them.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import materialize, per_key, spread

# Letters of other scripts with the look of a Latin letter, and that letter.
GREEK_CAPITALS, GREEK_CAPITALS_AS = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ABEZHIKMNOPTYXCJ"
GREEK_SMALL, GREEK_SMALL_AS = "ονϲϳ", "ovcj"
CYRILLIC_CAPITALS, CYRILLIC_CAPITALS_AS = "АВЕЅІЈКМНОРСТХҮԌԚԜӀѴӔӘ", "ABESIJKMHOPCTXYGQWIVÆƏ"
CYRILLIC_SMALL, CYRILLIC_SMALL_AS = "аеѕіјорсухһԁԛԝӏѵӕә", "aesijopcyxhdqwlvæə"
ARMENIAN, ARMENIAN_AS = "ՕՍԼՏօոսհզցյ", "OULSonuhqgj"
CHEROKEE, CHEROKEE_AS = "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏒᏔᏕᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHYGZRWSVSLCPKB"
CHEROKEE_SMALL, CHEROKEE_SMALL_AS = "ꮓꮩꮪꮯꮃ", "zvscw"
COPTIC, COPTIC_AS = "ⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "BHIKMNOPCTYXopc"
LISU, LISU_AS = "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"
LATIN_VARIANTS, LATIN_VARIANTS_AS = "ɡɑ", "ga"
# Marks with the look of another mark, and that mark.
MARKS, MARKS_AS = "∶∕⁄ʼ", "://’"
# Signs drawn as a hyphen (dashes and the minus sign are longer, so they stay).
HYPHENS = "-‐‑­﹣－"
# Ranges of default-ignorable code points (Unicode DerivedCoreProperties).
IGNORABLE = [(0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF)]

_LOOKS = {ord(a): b for x, y in (
    (GREEK_CAPITALS, GREEK_CAPITALS_AS), (GREEK_SMALL, GREEK_SMALL_AS), (CYRILLIC_CAPITALS, CYRILLIC_CAPITALS_AS), (CYRILLIC_SMALL, CYRILLIC_SMALL_AS), (ARMENIAN, ARMENIAN_AS),
    (CHEROKEE, CHEROKEE_AS), (CHEROKEE_SMALL, CHEROKEE_SMALL_AS), (COPTIC, COPTIC_AS), (LISU, LISU_AS), (LATIN_VARIANTS, LATIN_VARIANTS_AS), (MARKS, MARKS_AS),
) for a, b in zip(x, y, strict=True)}
#: Compatibility forms of the same signs at another place in a word, in another width or kept from breaking.
_SAME_SIGNS = ("<wide>", "<narrow>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>")


def _char(c: str) -> str:
    """The form of one character of decomposed text."""
    n = ord(c)
    if any(a <= n <= b for a, b in IGNORABLE):
        return ""
    if n in _LOOKS:
        return _LOOKS[n]
    if c in HYPHENS:
        return "-"
    kind = unicodedata.category(c)
    if kind == "Zs" or c == "\t":
        return " "
    if kind in ("Zl", "Zp") or c in "\r\x0b\x0c\x85":
        return "\n"
    if kind == "Cc" and c != "\n":
        return ""
    how = unicodedata.decomposition(c)
    built = how.startswith(_SAME_SIGNS) or c in "․‥…"
    if how.startswith("<compat>"):
        # letters joined into one sign, numerals built of letters, and radicals drawn as the ideograph
        built = built or kind[0] == "L" and len(how.split()) > 2 or kind == "Nl" or kind == "So" and len(how.split()) == 2
    if how.startswith("<square>"):  # units built of Latin letters
        built = built or unicodedata.normalize("NFKD", c).isascii() and unicodedata.normalize("NFKD", c).isalpha()
    if built:
        return "".join(map(_char, unicodedata.normalize("NFKD", c)))
    return c


class _Forms(dict):
    """Forms by code point, found once per distinct character."""

    def __missing__(self, n: int) -> str:
        self[n] = out = _char(chr(n))
        return out


_forms = _Forms()
#: Letters that are in form already when composed: nothing to do for a text of these and ASCII only.
_PLAIN = "".join(chr(n) for n in range(0xA1, 0x250) if all(_char(c) == c for c in unicodedata.normalize("NFD", chr(n))) and unicodedata.normalize("NFC", chr(n)) == chr(n) and chr(n) != "\xad")
_OTHER = re.compile(f"[^\n -~{re.escape(_PLAIN)}–—‘’“”█]")


def same_look(text: str) -> str:
    """The form of a text; idempotent; '' stays ''."""
    if not _OTHER.search(text):
        return text
    text = unicodedata.normalize("NFD", text.replace("\r\n", "\n")).translate(_forms)
    return unicodedata.normalize("NFC", text)


def folded(form: str) -> str:
    """The named form, of a visible one: compatibility composition and full case folding; equal wherever visible forms are."""
    if form.isascii():
        return form.lower()
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", form).casefold())


def _per_distinct(values: pd.Series, f) -> list:
    """f once per distinct value of a batch; null gives null."""
    known: dict = {None: None}
    out = []
    for v in values:
        if v not in known:
            known[v] = f(v)
        out.append(known[v])
    return out


@F.pandas_udf(T.StringType())
def normal_form(texts: pd.Series) -> pd.Series:
    return pd.Series(_per_distinct(texts, same_look), dtype=object)


def _digest(t: str) -> bytes:
    return hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()


@F.pandas_udf(T.StructType([T.StructField("fold", T.BinaryType()), T.StructField("look", T.BinaryType())]))
def look_digests(texts: pd.Series) -> pd.DataFrame:
    """128-bit digests of the folded and the visible form, so that only digests move on."""

    def both(t: str) -> tuple[bytes, bytes]:
        form = same_look(t)
        return _digest(folded(form)), _digest(form)

    found = _per_distinct(texts, both)
    return pd.DataFrame({"fold": [x[0] for x in found], "look": [x[1] for x in found]})


def digests(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, fold, look, same): digests of each non-null text's folded and visible form and of the text itself. A null id is no document."""
    rows = spread(docs.filter(F.col(text).isNotNull() & F.col(doc).isNotNull()).select(F.col(doc).alias("doc"), F.col(text).alias("text")), "doc")
    return rows.select("doc", look_digests("text").alias("x"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("same")).select("doc", "x.fold", "x.look", "same")


def _texts(made: DataFrame) -> DataFrame:
    """(fold, look, same, n, first): the distinct texts of which another text looks the same, with the class's number of texts and smallest document.

    Candidates are the folded forms of several texts; visible forms part them. Documents are first reduced to
    texts, with map-side combine, so copies of one text, however many, cost one row; a class of very many texts is met in salted parts.
    """
    one = made.groupBy("fold", "look", "same").agg(F.min("doc").alias("doc"))
    candidates = one.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("fold")
    one = one.join(candidates, "fold", "left_semi")
    alike = one.groupBy("fold", "look").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first")).filter("n > 1")
    return per_key(one.drop("doc"), alike, ["fold", "look"])


def classes(made: DataFrame) -> DataFrame:
    """One row per document whose class of the same look has several different texts: (doc, class, texts).

    ``class`` is the smallest document of the class; ``texts`` counts the different texts. The documents of one text, however many, are met in salted parts.
    """
    return per_key(made, _texts(made).drop("fold"), ["look", "same"]).select("doc", F.col("first").alias("class"), F.col("n").alias("texts"))


def lookalike_pairs(made: DataFrame) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b, of the documents that look the same but differ; each once where documents' ids are unique.

    Different texts of a class meet once each; their documents join on afterwards, salted on both sides, so
    the work is that of the result: identical texts never meet each other.
    """
    texts = materialize(_texts(made).select("look", "same"), "alike")
    held = per_key(made.select("look", "same", "doc"), texts, ["look", "same"])
    met = texts.select("look", F.col("same").alias("a")).join(texts.select("look", F.col("same").alias("b")), "look").filter(F.col("a") < F.col("b"))
    left = per_key(held.select("look", F.col("same").alias("a"), F.col("doc").alias("x")), met, ["look", "a"])
    pairs = per_key(left, held.select("look", F.col("same").alias("b"), F.col("doc").alias("y")), ["look", "b"]).filter(F.col("x") != F.col("y"))
    return pairs.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))


def change_report(docs: DataFrame, text: str = "text", by: str = "lang") -> DataFrame:
    """Per group how many texts the form changes."""
    changed = F.coalesce(normal_form(text) != F.col(text), F.lit(False))
    return docs.groupBy(F.col(by).alias(by)).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(changed.cast("bigint")).alias("n_changed"))
