"""Names, titles and dates."""

import re

from pyspark.sql import functions as F


def snake_names(names):
    """Column names in snake_case; repeated results get ``_2``, ``_3``, ..."""
    seen, out = {}, []
    for name in names:
        text = name.replace("%", " percent ").replace("#", " number ")
        text = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", text)
        text = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", text)
        text = re.sub(r"[^0-9a-zA-Z]+", "_", text).strip("_").lower()
        if not text or text[0].isdigit():
            text = f"x{text}"
        seen[text] = seen.get(text, 0) + 1
        out.append(text if seen[text] == 1 else f"{text}_{seen[text]}")
    return out


def clean_names(df):
    return df.toDF(*snake_names(df.columns))


def title_case(column):
    """First letter of each word upper, rest lower; a word also starts after a hyphen."""
    words = F.split(F.lower(column), "(?<=[ -])")
    lifted = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w))))
    return F.array_join(lifted, "")


def date_part(column):
    """Date of an ISO timestamp held as text; NULL where the text is no date."""
    return F.try_to_date(F.regexp_replace(column, "T.*", ""), "yyyy-MM-dd")


def full_name(first, last):
    return F.concat_ws(" ", first, last)


def many_parts(column):
    """Three words, or a hyphen: names that often come in several spellings."""
    return (F.regexp_count(column, F.lit(" ")) == 2) | F.contains(column, F.lit("-"))
