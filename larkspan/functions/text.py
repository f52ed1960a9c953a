"""Column functions for text: normalization steps, redaction, wording."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructType

from larkspan.plans.profile import MAX_BYTES, SECRET_PARAMETERS

#: Zero-width, direction and soft-hyphen characters.
INVISIBLE = "[​-‏‪-‮⁠-⁤⁦-⁯﻿­]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, and stands once in the plan, however often the body uses it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def half_even(value: Column) -> Column:
    """Nearest integer, halves to the even one, on the binary double."""
    return F.rint(value).cast("int")


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE, "")


def skeleton(text: Column, confusables: Sequence[tuple[str, str]]) -> Column:
    """The text with each confusable character replaced by what it is taken for, all at once; the last entry of a character counts."""
    table = dict(confusables)
    single = {s: t for s, t in table.items() if len(t) == 1}
    longer = {s: t for s, t in table.items() if len(t) != 1}
    simple = lambda c: F.translate(c, "".join(single), "".join(single.values())) if single else c
    if not longer:
        return simple(text)
    known = F.map_from_arrays(F.array(*map(F.lit, longer)), F.array(*map(F.lit, longer.values())))
    characters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    return F.array_join(F.transform(characters, lambda c: F.coalesce(F.try_element_at(known, c), simple(c))), "")


def percent_decode(text: Column, rounds: int = 2) -> Column:
    """Percent decoding that leaves a plus and malformed sequences as they are."""
    for _ in range(rounds):
        safe = F.regexp_replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
        text = F.when(text.contains("%"), F.url_decode(safe)).otherwise(text)
    return text


@F.pandas_udf(StructType().add("decoded", BooleanType()).add("changed", BooleanType()).add("text", StringType()))
def _plain(values: pd.Series) -> pd.DataFrame:
    decoded = [None if t is None else html.unescape(t) for t in values]
    forms = [None if t is None else unicodedata.normalize("NFKC", t) for t in decoded]
    rows = list(zip(values, decoded, forms))
    return pd.DataFrame({"decoded": [t is not None and d != t for t, d, _ in rows], "changed": [d is not None and f != d for _, d, f in rows], "text": forms})


#: Spark does not put it in place of its uses. Each mention is one more call and one more copy of the texts, so it is mentioned once, in let().
_plain = _plain.asNondeterministic()


def plain_form(text: Column) -> Column:
    """struct(decoded, changed, text): entities decoded and then the compatibility form; null where neither can change anything.

    Only texts with an ampersand or a character beyond ASCII are handed to Python.
    """
    return _plain(F.when(text.contains("&") | text.rlike("[^\\x00-\\x7F]"), text))


def size_error(text: Column, limit: int = MAX_BYTES) -> Column:
    """An error code for blank or oversized input, else null."""
    return (
        F.when(text.isNull() | (F.trim(text) == ""), "EMPTY_INPUT").when(F.octet_length(text) > limit, "PAYLOAD_TOO_LARGE").otherwise(F.lit(None).cast("string"))
    )


def normalized(text: Column, is_url: Column) -> Column:
    """struct(text, operations): the steps in order, and the names of those that changed something."""
    given = F.coalesce(text, F.lit(""))

    def named(x: Column) -> Column:
        plain, visible, decoded = x["plain"], x["visible"], x["decoded"]
        changes = [("html_entity_decode", plain["decoded"]), ("unicode_nfkc", plain["changed"]), ("zero_width_removed", visible != F.coalesce(plain["text"], x["given"])), ("url_decode", decoded != visible)]
        return F.struct(decoded.alias("text"), F.array_compact(F.array(*[F.when(changed, F.lit(name)) for name, changed in changes])).alias("operations"))

    def with_visible(x: Column) -> Column:
        return x.withField("visible", strip_invisible(F.coalesce(x["plain"]["text"], x["given"])))

    def with_decoded(x: Column) -> Column:
        return x.withField("decoded", F.when(x["is_url"] | x["visible"].contains("%"), _twice_decoded(x["visible"])).otherwise(x["visible"]))

    first = F.struct(plain_form(given).alias("plain"), given.alias("given"), is_url.alias("is_url"))
    return let(first, lambda x: let(with_visible(x), lambda y: let(with_decoded(y), named)))


def _twice_decoded(text: Column) -> Column:
    return let(percent_decode(text, 1), lambda once: percent_decode(once, 1))


def normal_text(text: Column) -> Column:
    """The text of normalized() for input that is no URL; what the percent layers come from is evaluated once."""
    given = F.coalesce(text, F.lit(""))
    plain = strip_invisible(F.coalesce(plain_form(given)["text"], given))
    return let(plain, lambda t: F.when(t.contains("%"), _twice_decoded(t)).otherwise(t))


@F.pandas_udf(ArrayType(StringType()))
def _each_plain(values: pd.Series) -> pd.Series:
    return values.map(lambda urls: None if urls is None else [None if u is None else unicodedata.normalize("NFKC", html.unescape(u)) for u in urls])


#: Spark does not put it in place of its uses.
_plain_all = _each_plain.asNondeterministic()


def normal_urls(urls: Column) -> Column:
    """The texts of normalized() for an array of URLs. Python runs only where one has an entity or a character beyond ASCII."""
    odd = lambda u: F.coalesce(u.contains("&") | u.rlike("[^\\x00-\\x7F]"), F.lit(False))
    plain = F.when(F.exists(urls, odd), _plain_all(urls)).otherwise(urls)
    return F.transform(plain, lambda u: let(strip_invisible(F.coalesce(u, F.lit(""))), percent_decode))


def visible_text(page: Column) -> Column:
    """Tags as spaces, white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(page, "<[^>]+>", " "), "[ \\t\\r\\n]+", " "))


def redact_emails(text: Column) -> Column:
    """Local parts: a -> a*, ab -> a*b, longer -> first***last."""
    edge, end = "(^|[^A-Za-z0-9._%+*-])", "(@[A-Za-z0-9-]+\\.[A-Za-z0-9.-]*[A-Za-z])"
    char = "[A-Za-z0-9._%+-]"
    text = F.regexp_replace(text, f"{edge}({char}){char}+({char}){end}", "$1$2***$3$4")
    text = F.regexp_replace(text, f"{edge}({char})({char}){end}", "$1$2*$3$4")
    return F.regexp_replace(text, f"{edge}({char}){end}", "$1$2*$3")


def redact_phones(text: Column) -> Column:
    """Eleven digits that begin with 1: the middle four are hidden."""
    return F.regexp_replace(text, "(^|[^0-9])(1[3-9][0-9])[0-9]{4}([0-9]{4})([^0-9]|$)", "$1$2****$3$4")


def redact_id_cards(text: Column) -> Column:
    """Eighteen digits (the last may be X): the middle thirteen are hidden."""
    return F.when(text.rlike("[0-9]{17}"), F.regexp_replace(text, "(?<![0-9])([0-9]{3})[0-9]{13}([0-9][0-9Xx])(?![0-9Xx])", "$1*************$2")).otherwise(text)


def redact_personal(text: Column) -> Column:
    """Numbers of identity cards and telephones and the local parts of addresses; texts without digits or an @ pass by the patterns."""
    text = redact_id_cards(text)
    text = F.when(text.rlike("1[3-9][0-9]{9}"), redact_phones(text)).otherwise(text)
    return F.when(text.contains("@"), redact_emails(text)).otherwise(text)


def redact_url(url: Column) -> Column:
    return redact_personal(redact_secrets(url))


def redact_and_shorten(text: Column, most: int = 160) -> Column:
    """A matched text on one line, redacted, then cut."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), "[\\r\\n]", " ")
    return shortened(redact_personal(redact_secrets(flat)), most)


def mixed_scripts(text: Column) -> Column:
    """Whether letters of two of the Latin, Cyrillic, Greek and Armenian scripts occur."""
    ranges = ("A-Za-z\\x{C0}-\\x{D6}\\x{D8}-\\x{F6}\\x{F8}-\\x{24F}", "\\x{400}-\\x{481}\\x{48A}-\\x{4FF}", "\\x{370}-\\x{373}\\x{376}-\\x{37D}\\x{37F}-\\x{3FF}", "\\x{531}-\\x{556}\\x{561}-\\x{587}")
    return sum((text.rlike(f"[{r}]").cast("int") for r in ranges), F.lit(0)) >= 2


def with_recognised(text: Column, recognised: Column) -> Column:
    """A normalized text and, on a line after it, the normalized text that was read from its image, if any."""
    blank = F.coalesce(F.trim(recognised), F.lit("")) == ""
    both = F.struct(normal_text(text).alias("text"), normal_text(F.when(~blank, recognised)).alias("more"), blank.alias("blank"))
    return let(both, lambda x: F.when(x["blank"], x["text"]).otherwise(F.concat(x["text"], F.lit("\n"), x["more"])))


def redact_secrets(url: Column) -> Column:
    """Passwords before a host and the values of secret parameters."""
    url = F.regexp_replace(url, "(://[^/@:\\s]*:)[^/@\\s]*(@)", "$1[REDACTED]$2")
    names = "|".join(SECRET_PARAMETERS)
    return F.regexp_replace(url, f"(?i)([?&#](?:{names})=)[^&#\\s]*", "$1[REDACTED]")


def shortened(text: Column, most: int = 160) -> Column:
    flat = F.regexp_replace(text, "\\n", " ")
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 3), F.lit("..."))).otherwise(flat)


def spread(word: str) -> str:
    """A pattern of a word with white space or invisible characters between its letters."""
    return f"[\\s{INVISIBLE[1:]}*".join(re.escape(c) for c in word)


def any_spread(text: Column, words: Sequence[str]) -> Column:
    """Whether one of the words occurs in the text in lower case, also with white space or invisible characters between its letters."""
    return F.lower(text).rlike("(?U)" + "|".join(spread(w.lower()) for w in words)) if words else F.lit(False)


def any_word(text: Column, words: Sequence[str]) -> Column:
    """Whether one of the words occurs in the text in lower case."""
    lower = F.lower(text)
    found = F.lit(False)
    for word in words:
        found = found | lower.contains(word)
    return found


def sentences(text: Column, full_stops: bool = True) -> Column:
    """Pieces between sentence ends, trimmed, without empty ones.

    Rules of wording call it without ``full_stops``: a full stop of Latin script then ends no sentence, since addresses have it.
    """
    parts = F.transform(F.split(text, f"[{'.' if full_stops else ''}!?。！？\\n]+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def first_sentence_with(text: Column, words: Sequence[str]) -> Column:
    """Zero-based number of the first sentence that has one of the words, else -1."""
    hits = F.transform(sentences(F.lower(text)), lambda s: any_word(s, words))
    return (F.array_position(hits, True) - 1).cast("int")


def first_sentence_with_spread(text: Column, words: Sequence[str]) -> Column:
    """Zero-based number of the first sentence that has the first of the words, in their order, that any_spread() sees in the text.

    0 if that word only occurs across sentences, or none does. Single words are looked for only where one of all is there.
    """
    if not words:
        return F.lit(0)
    patterns = F.array(*[F.lit("(?U)" + spread(w.lower())) for w in words])

    def placed(low: Column) -> Column:
        seen = F.get(F.filter(patterns, lambda p: F.regexp_like(low, p)), F.lit(0))
        return let(seen, lambda p: F.greatest(F.array_position(F.transform(sentences(low, full_stops=False), lambda s: F.regexp_like(s, p)), True) - 1, F.lit(0)).cast("int"))

    return F.when(any_spread(text, words), let(F.lower(text), placed)).otherwise(0)


def extension_layers(name: Column) -> Column:
    """Extensions of a file name, the outermost first."""
    parts = F.split(F.lower(F.rtrim(F.regexp_replace(name, "[ .]+$", ""))), "\\.")
    return F.reverse(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))))


def evidence_key(quote: Column, kind: Column) -> Column:
    """SHA-256 of the quote without white space, half-width and in lower case, with its type."""
    return F.sha2(F.concat_ws("|", evidence_form(quote), kind), 256)


def evidence_form(quote: Column) -> Column:
    """Without white space, some punctuation half-width, in lower case."""
    return F.lower(F.translate(F.regexp_replace(quote, "(?U)\\s+", ""), "：／．？＝＆（），。", ":/.?=&(),."))
