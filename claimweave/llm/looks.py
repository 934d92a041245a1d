"""Problem 5: visually identical text with different characters.

Compatibility composition (NFKC), mapped white space, removal of default-ignorable characters and look-alike letters, and
a full case fold as the comparison key; made once per distinct value of a task.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.runtime import ship

# Letters that have the shape of a Latin letter, each with that letter: Cyrillic, Greek, Armenian, Cherokee, Lisu,
# Coptic, phonetic.
LOOK_ALIKE = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХаеорсухіјѕһԁԛԝӏ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ" "ՕօհոսՏցյզԼ" "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ" "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ" "ⲞⲟⲢⲣⲤⲥⲔⲎⲘⲚⲦⲬⲂ" "ɡɑ",
        "ABESIJKMHOPCTYXaeopcyxijshdqwl" "ABEZHIKMNOPTYXovcj" "OohnuSgjqL" "ABCDEGHJKLMPRSTVWZ" "BPDTGKJCZFMNLSRVHWXYAEIOU" "OoPpCcKHMNTXB" "ga",
        strict=True,
    )
)
# Dashes and marks drawn like an ASCII one.
LOOK_ALIKE |= {"‐": "-", "‑": "-", "−": "-", "ʼ": "’"}
# Default-ignorable code points outside the format category.
IGNORABLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￰-￸\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff]")
_TABLE = str.maketrans(LOOK_ALIKE)
_SPACE = re.compile(r"\s+")
# characters whose compatibility form looks different (superscripts, circled, squared and fraction forms), found by their tag
_SHAPED = re.compile("([" + "".join(c for c in map(chr, [*range(0xA0, 0x3400), *range(0x1F100, 0x1F250)]) if unicodedata.decomposition(c).startswith(("<super", "<sub", "<circle", "<square", "<fraction"))) + "])")


def _compat(text: str) -> str:
    """NFKC, except for characters that don't look like their compatibility form."""
    if not _SHAPED.search(text):
        return unicodedata.normalize("NFKC", text)
    return unicodedata.normalize("NFC", "".join(x if i % 2 else unicodedata.normalize("NFKC", x) for i, x in enumerate(_SHAPED.split(text))))


def one_form(text: str) -> str:
    """The form in which two texts are equal exactly when they look alike; keeps case, accents and punctuation."""
    if text.isascii():
        return _SPACE.sub(" ", text).strip() if "  " in text or not text.isprintable() or text[:1] == " " or text[-1:] == " " else text
    text = _compat(IGNORABLE.sub("", text))
    # composed letters of other scripts come apart, so that their base can be mapped below the accent
    text = "".join(unicodedata.normalize("NFD", c) if "Ͱ" <= c <= "ԯ" else c for c in text).translate(_TABLE)
    text = _compat(text)
    return _SPACE.sub(" ", IGNORABLE.sub("", text)).strip()


def folded(text: str) -> str:
    """one_form under full case folding: the key for searches that disregard case."""
    return _compat(one_form(text).casefold())


#: Distinct values a task remembers before it forgets them all.
MEMO = 50_000


def _per_distinct(column: pa.Array, func, memo: dict[str, str]) -> pa.Array:
    coded = column.dictionary_encode() if not isinstance(column, pa.DictionaryArray) else column
    out = []
    for v in coded.dictionary.to_pylist():
        form = None if v is None else memo.get(v)
        if form is None and v is not None:
            if len(memo) >= MEMO:
                memo.clear()
            form = memo[v] = func(v)
        out.append(form)
    return pc.take(pa.array(out, type=pa.string()), coded.indices)


def normalised(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """keep, and for each column c: c (as it was), c_form (one_form) and c_key (folded). Nulls stay null, empty stays empty."""
    ship(df.sparkSession)
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    outs = [f"`{c}` string, `{c}_form` string, `{c}_key` string" for c in columns]

    def run(batches):
        forms: dict[str, str] = {}
        keys: dict[str, str] = {}
        for batch in batches:
            arrays = [batch.column(i) for i in range(len(keep))]
            for i in range(len(keep), len(keep) + len(columns)):
                col = batch.column(i)
                form = _per_distinct(col, one_form, forms)
                arrays += [col, form, _per_distinct(form, lambda v: _compat(v.casefold()), keys)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    names = [*keep, *[x for c in columns for x in (c, f"{c}_form", f"{c}_key")]]
    return df.select(*keep, *[F.col(c).cast("string").alias(c) for c in columns]).mapInArrow(run, ", ".join([*kinds, *outs]))


def ascii_form(c: Column) -> Column:
    """one_form of a text of ASCII characters, without leaving the JVM."""
    return F.trim(F.regexp_replace(c, r"[\t-\r\x1c-\x20]+", " "))


def alike_but_different(df: DataFrame, id_col: str, left: str, right: str) -> DataFrame:
    """(id): ids whose two texts are both present (not null, not blank), differ as strings and have one form.

    Pairs of ASCII texts differ in white space only, which the JVM settles. Of the others the folded keys are compared
    first; the exact check keeps only pairs equal in case too.
    """
    differ = df.where((F.col(left) != F.col(right)) & F.col(id_col).isNotNull()).select(id_col, left, right)
    plain = F.col(left).rlike(r"\A\p{ASCII}*\z") & F.col(right).rlike(r"\A\p{ASCII}*\z")
    easy = differ.where(plain & (ascii_form(F.col(left)) == ascii_form(F.col(right))) & (ascii_form(F.col(left)) != "")).select(F.col(id_col).alias("id"))
    pairs = normalised(differ.where(~plain), [left, right], [id_col])
    same = (F.col(f"{left}_key") == F.col(f"{right}_key")) & (F.col(f"{left}_form") == F.col(f"{right}_form"))
    return pairs.where(same & (F.col(f"{left}_form") != "")).select(F.col(id_col).alias("id")).unionByName(easy).distinct()
