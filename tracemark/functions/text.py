"""Text semantics of evidence: normal forms, references, quotes, times.

Columns stay in the JVM wherever Spark has the semantics; the three kernels that need Python's
Unicode rules (NFKC, code-point offsets, word boundaries) are Arrow-batched pandas UDFs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

# Characters that count as their plain forms, and limits of a quote.
CURLY = "‘’“”⏎"
PLAIN = "''\"\" "
MIN_QUOTE_CHARS = 8
MAX_QUOTE_WORDS = 60
# States and codes, and spellings of the same item.
STATES = {
    "alabama": "AL", "alaska": "AK", "arizona": "AZ", "arkansas": "AR", "california": "CA", "colorado": "CO",
    "connecticut": "CT", "delaware": "DE", "district of columbia": "DC", "florida": "FL", "georgia": "GA",
    "hawaii": "HI", "idaho": "ID", "illinois": "IL", "indiana": "IN", "iowa": "IA", "kansas": "KS",
    "kentucky": "KY", "louisiana": "LA", "maine": "ME", "maryland": "MD", "massachusetts": "MA",
    "michigan": "MI", "minnesota": "MN", "mississippi": "MS", "missouri": "MO", "montana": "MT",
    "nebraska": "NE", "nevada": "NV", "new hampshire": "NH", "new jersey": "NJ", "new mexico": "NM",
    "new york": "NY", "north carolina": "NC", "north dakota": "ND", "ohio": "OH", "oklahoma": "OK",
    "oregon": "OR", "pennsylvania": "PA", "puerto rico": "PR", "rhode island": "RI", "south carolina": "SC",
    "south dakota": "SD", "tennessee": "TN", "texas": "TX", "utah": "UT", "vermont": "VT", "virginia": "VA",
    "washington": "WA", "west virginia": "WV", "wisconsin": "WI", "wyoming": "WY",
}
ALIASES = {
    "cze": "czech republic", "czech": "czech republic", "hun": "hungary", "pol": "poland",
    "svk": "slovak republic", "slovak": "slovak republic", "svn": "slovenia", "col": "colombia",
    "mex": "mexico", "chl": "chile", "ita": "italy",
    "wwii": "world war ii", "gulf90s": "gulf war (1990s)", "gulf2001": "gulf war (2001-)",
    "85": "85 and older", "85+": "85 and older",
    "males 2016": "male 2016", "males in 2016": "male 2016", "f2017": "female 2017",
    "personal advisors": "personal financial advisors",
    "credit counselors/loan officers": "credit counselors and loan officers",
    "credit/loan": "credit counselors and loan officers",
    "insurance": "insurance sales agents", "insurance agents": "insurance sales agents",
    "csr": "customer service representatives", "customer service": "customer service representatives",
    "customer service reps": "customer service representatives",
    "msu": "michigan state university", "capella": "capella university",
}
SIGNATURE = r"--\s*([A-Za-z][A-Za-z0-9_\-]{2,60})"
EDGE = " .:*`'\""


def normalized(text: str) -> str:
    plain = unicodedata.normalize("NFKC", text).translate(str.maketrans(CURLY, PLAIN))
    return " ".join(plain.split()).lower()


@F.pandas_udf(StringType())
def normalize(text: pd.Series) -> pd.Series:
    """Compatibility form, plain quotes, single blanks, lower case; null stays null."""
    return text.map(lambda t: None if t is None else normalized(t))


def quote_offset(text: str, quote: str) -> int:
    """Code-point offset of the first occurrence of ``quote`` that doesn't cut a word, or -1."""
    word = lambda c: c.isalnum() or c == "_"
    at = text.find(quote) if quote else -1
    while at >= 0:
        end = at + len(quote)
        cut_left = at > 0 and word(quote[0]) and word(text[at - 1])
        cut_right = end < len(text) and word(quote[-1]) and word(text[end])
        if not (cut_left or cut_right):
            return at
        at = text.find(quote, at + 1)
    return -1


@F.pandas_udf(IntegerType())
def find_quote(text: pd.Series, quote: pd.Series) -> pd.Series:
    """Offset of a normalized quote in a normalized text; null if either is null."""
    return pd.Series([None if t is None or q is None else quote_offset(t, q) for t, q in zip(text, quote)], dtype="Int32")


#: From so many quotes on, a text is walked through once for all of them.
SEVERAL = 8


def quote_offsets(text: str, quotes: list[str]) -> list[int]:
    """``quote_offset`` of each quote."""
    if len(quotes) < SEVERAL or "" in quotes:
        return [quote_offset(text, q) for q in quotes]
    import ahocorasick

    word = lambda c: c.isalnum() or c == "_"
    found, automaton = dict.fromkeys(quotes, -1), ahocorasick.Automaton()
    for q in found:
        automaton.add_word(q, q)
    automaton.make_automaton()
    for last, q in automaton.iter(text):
        at = last + 1 - len(q)
        if found[q] >= 0 or (at > 0 and word(q[0]) and word(text[at - 1])):
            continue
        if last + 1 == len(text) or not (word(q[-1]) and word(text[last + 1])):
            found[q] = at
    return [found[q] for q in quotes]


@F.pandas_udf(ArrayType(IntegerType()))
def find_quotes(text: pd.Series, quotes: pd.Series) -> pd.Series:
    """Offsets of normalized quotes in the normal form of a text; null for a null text."""
    return pd.Series([None if t is None or q is None else quote_offsets(normalized(t), list(q)) for t, q in zip(text, quotes)])


def quote_span(text: str, quote: str) -> list[int] | None:
    """[start, end) of a quote in the original text: any white space matches, case doesn't count."""
    fold = str.maketrans(CURLY, PLAIN)
    parts = [re.escape(w) for w in quote.translate(fold).split()]
    hit = re.search(r"\s+".join(parts), text.translate(fold), re.IGNORECASE) if parts else None
    return list(hit.span()) if hit else None


@F.pandas_udf(ArrayType(IntegerType()))
def locate(text: pd.Series, quote: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or q is None else quote_span(t, q) for t, q in zip(text, quote)])


def fold(text: Column) -> Column:
    """Plain quotes one for one, so that offsets stay valid."""
    return F.translate(text, CURLY, PLAIN)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def digits(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\D", "")


def tail_of(event_id: Column) -> Column:
    """What follows the last colon, without hyphens."""
    return F.replace(F.substring_index(event_id, ":", -1), F.lit("-"), F.lit(""))


def ref_of(event_id: Column) -> Column:
    return F.substring(tail_of(event_id), 1, 10)


def is_ref(ref: Column) -> Column:
    """A short reference: 8 to 40 hex digits or hyphens, at least 8 of them digits."""
    return ref.rlike(r"^[0-9a-f-]{8,40}$") & (F.length(F.replace(ref, F.lit("-"), F.lit(""))) >= 8)


def clip(text: Column, n: int) -> Column:
    more = F.concat(F.left(text, F.lit(n)), F.lit("...[+"), (F.length(text) - n).cast("string"), F.lit(" chars]"))
    return F.when(F.length(text) > n, more).otherwise(text)


def clip_end(text: Column, n: int) -> Column:
    more = F.concat(F.lit("["), (F.length(text) - n).cast("string"), F.lit(" chars]..."), F.right(text, F.lit(n)))
    return F.when(F.length(text) > n, more).otherwise(text)


def parse_ts(raw: Column) -> Column:
    """Seconds or milliseconds since 1970, or an ISO time (UTC unless it says otherwise)."""
    number = F.when(raw.rlike(r"^-?\d+(\.\d+)?$"), raw.cast("double"))
    epoch = F.timestamp_seconds(F.when(F.abs(number) > 1e11, number / 1000).otherwise(number))
    return F.when(F.trim(raw) == "", None).otherwise(F.coalesce(epoch, F.try_to_timestamp(raw)))


def norm_time(raw: Column) -> Column:
    """An exact ISO time stays; 9 to 11 digits are seconds since 1970; anything else is empty."""
    s = F.trim(F.coalesce(raw, F.lit("")))
    epoch = F.date_format(F.timestamp_seconds(F.when(s.rlike(r"^\d{9,11}$"), s.cast("long"))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.when(s.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$"), s).otherwise(F.coalesce(epoch, F.lit("")))


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, however often body mentions it (inside a lambda, too)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def norm_item(item: Column) -> Column:
    """One spelling for an item: a state's code, else lower case without county and aliases."""
    codes = F.array(*[F.lit(c) for c in STATES.values()])
    place = r"^(.+?)(?: county)?,? ([a-z]{2})$"

    def spelled(s: Column) -> Column:
        def local(t: Column) -> Column:
            in_state = F.array_contains(codes, F.upper(F.regexp_extract(t, place, 2)))
            name = F.regexp_replace(F.when(in_state, F.regexp_extract(t, place, 1)).otherwise(t), " county$", "")
            return bind(name, lambda n: F.coalesce(F.try_element_at(_lookup(ALIASES), n), n))

        is_code = (F.length(s) == 2) & F.array_contains(codes, F.upper(s))
        return F.when(is_code, F.upper(s)).otherwise(F.coalesce(F.try_element_at(_lookup(STATES), s), bind(F.replace(s, F.lit(" & "), F.lit(" and ")), local)))

    return bind(F.lower(F.btrim(squeeze(F.coalesce(item, F.lit(""))), F.lit(EDGE))), spelled)


def item_in_quote(item: Column, quote: Column) -> Column:
    """The item's words stand in the quote, or its state does by name or code."""
    names: dict[str, list[str]] = {}
    for name, code in STATES.items():
        names.setdefault(code, []).append(name)
    of_code = F.create_map(*[x for c, n in names.items() for x in (F.lit(c), F.array(*map(F.lit, n)))])

    def stands(f: Column) -> Column:
        named = F.exists(F.coalesce(F.try_element_at(of_code, f["code"]), F.array().cast("array<string>")), lambda n: f["q"].contains(n))
        coded = f["code"].isin(list(STATES.values())) & F.regexp_like(f["q"], F.concat(F.lit(r"(?U)\b"), F.lower(f["code"]), F.lit(r"\b")))
        return F.when(f["it"] == "", False).otherwise(f["q"].contains(f["it"]) | named | coded)

    return bind(F.struct(norm_item(item).alias("code"), F.lower(quote).alias("q"), F.btrim(F.lower(squeeze(item)), F.lit(EDGE)).alias("it")), stands)


def signature(text: Column) -> Column:
    """The last ``-- Name`` of a text."""
    found = F.regexp_extract_all(text, F.lit(SIGNATURE), 1)
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def signature_after(text: Column, quote: Column) -> Column:
    """The first signature behind the quote, else the last of the text."""
    t, q = squeeze(text), squeeze(quote)
    at = F.position(q, t)
    after = F.regexp_extract(F.substr(t, at + F.length(q)), SIGNATURE, 1)
    return F.when((at > 0) & (after != ""), after).otherwise(signature(t))


def aliases(actor: Column) -> Column:
    """Names under which an actor may be mentioned: whole, without "claude ", the last two words."""
    low = F.lower(actor)
    words = F.split(low, " ")
    last = F.when(F.size(words) > 2, F.array_join(F.slice(words, -2, 2), " "))
    return F.array_distinct(F.filter(F.array(low, F.regexp_replace(low, "^claude ", ""), last), lambda x: x.isNotNull()))


def script_safe(json: Column) -> Column:
    """JSON that may stand inside a script element."""
    for raw, safe in (("<!--", "\\u003c!--"), ("<script", "\\u003cscript"), ("</", "<\\/"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        json = F.replace(json, F.lit(raw), F.lit(safe))
    return json
