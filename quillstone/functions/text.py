"""Text folding: camel case, white space, Unicode and Arabic letters, shares of scripts, natural keys."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters, digits and marks of punctuation that count as one; a lengthening stroke is a space.
FOLDED = {"أ": "ا", "إ": "ا", "آ": "ا", "ى": "ي", "ة": "ه", "ؤ": "و", "ئ": "ي"}
FOLDED |= {d: str(i) for digits in ("٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹") for i, d in enumerate(digits)}
FOLDED |= {"،": ",", "؛": ";", "؟": "?", "ـ": " "}
ARABIC = r"[؀-ۿݐ-ݿ]"
#: Fixed value: natural keys such as ORD-12-7.
KEY = r"\b[A-Za-z]{1,6}-\d[\d-]*"


def squeezed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"[ \t\r\n]+", " "))


def fold_camel(x: Column) -> Column:
    """customerName and HTTPStatus to lower words."""
    x = F.regexp_replace(x, "([a-z0-9])([A-Z])", "$1 $2")
    x = F.regexp_replace(x, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.lower(squeezed(F.regexp_replace(x, "[_.-]+", " ")))


def normalized(x: Column, compatible=None) -> Column:
    """Controls and marks dropped, lower case, letters and digits folded, punctuation and spaces to one space; symbols stay.
    `compatible` applies NFKC first."""
    x = F.lower(F.regexp_replace(compatible(x) if compatible else x, r"[\p{Cc}\p{Mn}]", ""))
    x = F.translate(x, "".join(FOLDED), "".join(FOLDED.values()))
    return F.trim(F.regexp_replace(x, r"[\p{P}\p{Z}]+", " "))


def nfkc():
    """NFKC has no built-in function: a vectorised function over Arrow batches."""
    @F.pandas_udf("string")
    def fold(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))

    return fold


def arabic_share(x: Column) -> Column:
    letters = F.regexp_count(x, F.lit(r"\p{L}"))
    return F.when(letters == 0, 0.0).otherwise(F.regexp_count(x, F.lit(ARABIC)) / letters)


def language(x: Column, least: float = 0.30) -> Column:
    return F.when(arabic_share(x) >= least, "ar").otherwise("en")


def script_profile(x: Column) -> Column:
    """mixed if the minor script has 8 letters or more and a quarter of the major's."""
    arabic, latin = F.regexp_count(x, F.lit(ARABIC)), F.regexp_count(x, F.lit("[A-Za-z]"))
    minor, major = F.least(arabic, latin), F.greatest(arabic, latin)
    return F.when((minor >= 8) & (minor >= 0.25 * major), "mixed").when(arabic > latin, "arabic").when(latin > 0, "latin").otherwise("none")


def natural_keys(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(KEY), F.lit(0))
