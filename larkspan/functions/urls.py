"""Column functions for URLs and domains, without a URL library: any text gets a result."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from larkspan.functions.text import let
from larkspan.plans.profile import TWO_PART_SUFFIXES

_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_IPV4 = r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"


def parts(url: Column) -> Column:
    """struct(scheme, userinfo, host, port, path, query, fragment, warning)."""
    piece = [F.regexp_extract(url, _SPLIT, k) for k in range(1, 6)]
    authority = piece[1]
    host_port = F.regexp_replace(authority, "^.*@", "")
    port_text = F.regexp_extract(host_port, ":([^:\\]]*)$", 1)
    port = port_text.try_cast("int")
    fine = port.isNotNull() & (port >= 0) & (port <= 65535)
    host = F.lower(F.regexp_replace(F.regexp_replace(host_port, ":[^:\\]]*$", ""), "\\.+$", ""))
    return F.struct(
        F.lower(piece[0]).alias("scheme"),
        F.regexp_extract(authority, "^(.*)@", 1).alias("userinfo"),
        host.alias("host"),
        F.when(fine, port).alias("port"),
        piece[2].alias("path"),
        piece[3].alias("query"),
        piece[4].alias("fragment"),
        F.when((port_text != "") & ~F.coalesce(fine, F.lit(False)), "invalid_port").alias("warning"),
    )


def registered_domain(host: Column, suffixes: Sequence[str] = TWO_PART_SUFFIXES) -> Column:
    """The label below the longest of the public ``suffixes`` (of any number of labels) and that suffix; an IPv4 address is itself.

    A host without one of them is taken to have a suffix of one label.
    """
    labels = F.split(host, "\\.")
    n = F.size(labels)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), F.lit(k)), ".")
    found = F.when(host.rlike(_IPV4) | (n <= 2), host)
    for k in sorted({s.count(".") + 1 for s in suffixes if "." in s}, reverse=True):
        found = found.when((n >= k) & last(k).isin(*[s for s in suffixes if s.count(".") + 1 == k]), last(k + 1))
    return found.otherwise(last(2))


def subdomain_levels(host: Column) -> Column:
    above = F.size(F.split(host, "\\.")) - F.size(F.split(registered_domain(host), "\\."))
    return F.when(host.rlike(_IPV4) | (host == ""), 0).otherwise(above).cast("int")


def core_label(host: Column) -> Column:
    return F.split_part(registered_domain(host), F.lit("."), F.lit(1))


def belongs_to(host: Column, domains: Sequence[str], itself: bool = True) -> Column:
    """Whether the host is one of the domains (if ``itself``) or below one."""
    found = F.lit(False)
    for d in domains:
        found = found | host.endswith(f".{d}") | (host == d if itself else F.lit(False))
    return found


def public_ip(host: Column) -> Column:
    """Whether the host is an IP address that is neither private, loopback, link-local nor reserved for documentation or tests."""
    a, b, c, d = (F.split_part(host, F.lit("."), F.lit(k)).try_cast("int") for k in (1, 2, 3, 4))
    address = host.rlike(_IPV4) & (a <= 255) & (b <= 255) & (c <= 255) & (d <= 255)
    reserved = (
        a.isin(0, 10, 127)
        | (a >= 240)
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
        | ((a == 169) & (b == 254))
        | ((a == 198) & b.isin(18, 19))
        | ((a == 192) & (b == 0) & c.isin(0, 2))
        | ((a == 198) & (b == 51) & (c == 100))
        | ((a == 203) & (b == 0) & (c == 113))
    )
    long_address = host.rlike("^\\[[0-9a-f]*:[0-9a-f:.]*\\]$")
    own = host.rlike("^\\[(?:::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|2001:0?db8:.*|::ffff:.*|100::.*)\\]$")
    return F.coalesce((address & ~reserved) | (long_address & ~own), F.lit(False))


def _decoded(host: str) -> str:
    labels = [x[4:].encode("ascii").decode("punycode") if x.startswith("xn--") else x for x in host.split(".")]
    return ".".join(labels).lower()


def _try_decoded(host: str | None) -> str | None:
    try:
        return host if host is None or "xn--" not in host else _decoded(host)
    except (UnicodeError, ValueError):
        return host


@F.pandas_udf(StringType())
def _idna(hosts: pd.Series) -> pd.Series:
    return hosts.map(_try_decoded, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def _each_idna(hosts: pd.Series) -> pd.Series:
    return hosts.map(lambda h: None if h is None else [_try_decoded(x) for x in h])


#: Spark does not put it in place of its uses: inside a large expression of other Python functions it would stay where no Python runs.
_idna_all = _each_idna.asNondeterministic()


def decoded_host(host: Column) -> Column:
    """The host with its xn-- labels decoded; one that cannot be decoded as it is."""
    return F.when(host.contains("xn--"), _idna(host)).otherwise(host)


def decoded_hosts(hosts: Column) -> Column:
    """decoded_host() of an array. Python runs only where a host needs it."""
    return F.when(F.exists(hosts, lambda h: h.contains("xn--")), _idna_all(hosts)).otherwise(hosts)


@F.pandas_udf(StringType())
def _joined(bases: pd.Series, links: pd.Series) -> pd.Series:
    out = []
    for base, link in zip(bases, links):
        try:
            out.append(urljoin(base, link) if base else link)
        except ValueError:
            out.append(link)
    return pd.Series(out, dtype=object)


def resolved(link: Column, base: Column) -> Column:
    """A link as an absolute URL on its base; null unless it is one of http or https."""
    link = F.trim(F.coalesce(link, F.lit("")))
    full = F.when(link.rlike("^https?://"), link).when(link != "", _joined(F.coalesce(base, F.lit("")), link))
    return F.when(full.rlike("^https?://"), full)


# Characters that are taken off the end of a URL, each for its own purpose.
TRAILING = {
    "rules": ".,);!?]}。，；！？）】〉》\"'",
    "normalizer": ".,:);!?]}。，；：！？）】〉》\"'",
    "model": ".,;:!?）)】〕〗\"'",
    "findings": ".,;:!?)】",
}


def without_trailing(url: Column, purpose: str = "rules") -> Column:
    """A URL without the punctuation after it."""
    return F.rtrim(url, F.lit(TRAILING[purpose]))


def canonical_key(url: Column, host: Column | None = None) -> Column:
    """The URL with scheme and host in lower case and without a default port; ``host`` replaces a decoded host.

    The user's name and a hidden password stay only where no port is left.
    """
    return let(parts(url), lambda p: _key_of(p, host))


def _key_of(p: Column, host: Column | None) -> Column:
    default = ((p["scheme"] == "http") & (p["port"] == 80)) | ((p["scheme"] == "https") & (p["port"] == 443))
    user, secret = F.regexp_extract(p["userinfo"], "^([^:]*)", 1), F.regexp_extract(p["userinfo"], ":(.+)$", 1)
    before = F.when(p["userinfo"] == "", "").otherwise(F.concat(user, F.when((user != "") & (secret != ""), ":[REDACTED]").otherwise(""), F.lit("@")))
    name = p["host"] if host is None else host
    place = F.when(p["port"].isNotNull() & ~default, F.concat(name, F.lit(":"), p["port"].cast("string"))).otherwise(F.concat(before, name))
    query = F.when(p["query"] == "", "").otherwise(F.concat(F.lit("?"), p["query"]))
    fragment = F.when(p["fragment"] == "", "").otherwise(F.concat(F.lit("#"), p["fragment"]))
    return F.concat(p["scheme"], F.lit("://"), place, p["path"], query, fragment)


def first_of_each(urls: Column) -> Column:
    """An array of structs with ``url`` without those whose canonical key an earlier one has; the order stays."""
    keyed = lambda us: F.filter(F.transform(us, lambda u, i: F.struct(canonical_key(u["url"]).alias("key"), i.alias("at"))), lambda x: x["key"].isNotNull())
    # sorted by key and place, the first of each key stands behind another key
    firsts = lambda xs: F.filter(xs, lambda x, k: (k == 0) | (F.get(xs, k - 1)["key"] != x["key"]))
    places = lambda us: F.array_sort(F.transform(let(F.array_sort(keyed(us)), firsts), lambda x: x["at"]))
    return let(urls, lambda us: F.transform(places(us), lambda at: F.get(us, at)))


def in_text(text: Column) -> Column:
    """The http and https URLs of a text, in order, without trailing punctuation and repeats."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?i)(https?://[^\\s<>\"'\u3000]+)")), lambda u: F.struct(without_trailing(u).alias("url")))
    return F.transform(first_of_each(found), lambda u: u["url"])


_WRITTEN = "(?i)(https?://[^\\s<>\"'{}\\[\\]()（）\\x{4E00}-\\x{9FFF}]*)"


def written_urls(text: Column, suffixes: Sequence[str]) -> Column:
    """The URLs that a text writes out, in order and as often as it does, then its bare domains of distrusted suffixes."""
    text = F.coalesce(text, F.lit(""))
    full = F.transform(F.regexp_extract_all(text, F.lit(_WRITTEN)), lambda u: without_trailing(F.trim(u), "model"))
    return F.concat(F.filter(full, lambda u: u != ""), bare_domains(text, suffixes))


def bare_domains(text: Column, suffixes: Sequence[str]) -> Column:
    """Domains of distrusted suffixes that a text names without a scheme, as https URLs, in order and once each.

    URLs and e-mail addresses are blanked first; hosts that a URL of the text has are left out, as are version numbers.
    """
    blank = lambda c, pattern: F.regexp_replace(c, pattern, " \u0000 ")
    hosts = F.transform(F.regexp_extract_all(text, F.lit(_WRITTEN)), lambda u: parts(without_trailing(u, "model"))["host"])
    rest = blank(blank(text, "(?i)https?://\\S+"), "(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{2,}")
    label = "[a-zA-Z0-9](?:[-a-zA-Z0-9]*[a-zA-Z0-9])?"
    pattern = f"(?i)(?<![@\\w.-])({label}(?:\\.{label})*\\.(?:{'|'.join(suffixes)}))(?:/[\\w\\-._~:/?#\\[\\]@!$&()*+,;=%]*)?(?=[\\s\\)\\]\\}},;:!?.。，、：》）“”‘’-]|$)"
    found = F.regexp_extract_all(rest, F.lit(pattern), F.lit(1))
    keep = lambda d: ~F.lower(d).rlike("^v[0-9]+\\.[0-9]+") & ~F.array_contains(hosts, F.lower(d))
    own = F.filter(found, keep)
    lower = F.transform(own, lambda d: F.lower(d))
    firsts = F.filter(F.transform(own, lambda d, i: F.when(F.array_position(lower, F.lower(d)) == i + 1, d)), lambda d: d.isNotNull())
    return F.transform(firsts, lambda d: F.concat(F.lit("https://"), d))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def with_scheme(url: Column) -> Column:
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).when(~url.contains("://"), F.concat(F.lit("https://"), url)).otherwise(url)
