"""Forms, links and title of pages in one Arrow pass, and the rules that need them as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from larkspan.functions import text as T
from larkspan.functions import urls as U
from larkspan.operators.rules import evidence
from larkspan.operators.scoring import let
from larkspan.plans.profile import Profile

# Words of fields that hold personal data, secrets, and secrets of high value.
SENSITIVE = ("phone", "mobile", "email", "address", "student_id", "id_card", "name")
SECRET = ("password", "passwd", "pwd", "token", "bank_card", "sms_code", "payment_password", "pin")
HIGH_VALUE = ("token", "bank_card", "sms_code", "payment_password")

_STRINGS = ("tag", "name", "id", "type", "placeholder", "aria_label", "label")
_FIELD = StructType([StructField(k, StringType()) for k in _STRINGS])
_FORM = StructType([StructField("action", StringType()), StructField("target", StringType()), StructField("fields", ArrayType(_FIELD))])
_LINK = StructType([StructField("href", StringType()), StructField("text", StringType()), StructField("target", StringType())])
PAGE = StructType(
    [StructField("title", StringType()), StructField("forms", ArrayType(_FORM)), StructField("links", ArrayType(_LINK)), StructField("loose_password", BooleanType()), StructField("iframes", ArrayType(StringType())), StructField("metas", ArrayType(StringType()))]
)


#: The address in the content of a refresh.
_REFRESH_URL = re.compile(r"url=\s*([^;,\s]+)", re.IGNORECASE)


class _Reader(HTMLParser):
    """Collects forms with their fields and labels, links with their texts, addresses of iframes, and the title. A new form ends an open one."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.title, self.forms, self.links = base, "", [], []
        self.form, self.link, self.label, self.in_title = None, None, None, False
        self.labels: dict[str, str] = {}
        self.loose_password = False
        self.iframes: list[str] = []
        self.metas: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in reversed(attrs)}
        if tag == "form":
            target = urljoin(self.base, a.get("action", "").strip()) if self.base or a.get("action") else ""
            self.form = {"action": a.get("action", "").strip(), "target": target, "fields": []}
            self.forms.append(self.form)
        elif tag in ("input", "select", "textarea"):
            own = {k: a.get(k.replace("_", "-"), "") for k in _STRINGS} | {"tag": tag, "type": a.get("type", "").lower(), "label": ""}
            own["_in"] = self.label
            if self.form is not None:
                self.form["fields"].append(own)
            elif own["type"] == "password":
                self.loose_password = True
        elif tag == "a" and "href" in a:
            self.link = {"href": a["href"].strip(), "text": "", "target": self.resolved(a["href"].strip())}
            self.links.append(self.link)
        elif tag == "iframe" and "src" in a:
            self.iframes.append(a["src"])
        elif tag == "meta" and a.get("http-equiv", "").lower() == "refresh":
            if goal := _REFRESH_URL.search(a.get("content", "")):
                self.metas.append(self.resolved(goal.group(1).strip("\"'")))
        elif tag == "label":
            self.label = {"for": a.get("for", ""), "text": ""}
        elif tag == "title":
            self.in_title = True

    def resolved(self, link: str) -> str:
        try:
            return urljoin(self.base, link) if self.base else link
        except ValueError:
            return link

    def handle_endtag(self, tag):
        if tag == "form":
            self.form = None
        elif tag == "a":
            self.link = None
        elif tag == "label" and self.label is not None:
            if self.label["for"]:
                self.labels.setdefault(self.label["for"], self.label["text"].strip())
            self.label = None
        elif tag == "title":
            self.in_title = False

    def handle_data(self, data):
        if self.link is not None:
            self.link["text"] += data
        if self.label is not None:
            self.label["text"] += data
        if self.in_title:
            self.title += data

    def result(self) -> dict:
        for form in self.forms:
            for f in form["fields"]:
                around = f.pop("_in")
                f["label"] = self.labels.get(f["id"]) or (around["text"].strip() if around else "")
        for link in self.links:
            link["text"] = link["text"].strip()
        return {"title": self.title.strip(), "forms": self.forms, "links": self.links, "loose_password": self.loose_password, "iframes": self.iframes, "metas": self.metas}


def read_page(page: str | None, base: str | None) -> dict:
    if not page:
        return {"title": "", "forms": [], "links": [], "loose_password": False, "iframes": [], "metas": []}
    reader = _Reader(base or "")
    try:
        reader.feed(page or "")
        reader.close()
    except (AssertionError, ValueError):  # a malformed declaration or address: what was read so far counts
        pass
    return reader.result()


@F.pandas_udf(PAGE)
def flattened(pages: pd.Series, bases: pd.Series) -> pd.DataFrame:
    """struct(title, forms, links, loose_password, iframes) of a page and the URL that it came from."""
    return pd.DataFrame([read_page(p, b) for p, b in zip(pages, bases)], columns=PAGE.names)


#: The same for plans that use the struct often: Spark neither puts it in place of each use nor repeats what stands above it for each table of a union.
flattened_once = F.pandas_udf(flattened.func, PAGE).asNondeterministic()


def _searched(field: Column) -> Column:
    return F.lower(F.concat_ws(" ", field["name"], field["id"], field["placeholder"], field["label"], field["aria_label"]))


def has_word(form: Column, words: Sequence[str]) -> Column:
    """Whether a field of the form has one of the words in its names or labels."""
    return F.exists(form["fields"], lambda f: T.any_word(_searched(f), words))


def has_password(form: Column) -> Column:
    return F.exists(form["fields"], lambda f: f["type"] == "password")


def brand_signals(dom: Column, page: Column, profile: Profile) -> Column:
    """How many places of a page name the brand: title, two words in the text, a form's label, two links."""
    words = profile.brand_words
    in_body = F.lit(0)
    for w in words:
        in_body = in_body + F.when(F.lower(page).contains(w), 1).otherwise(0)
    labels = F.exists(dom["forms"], lambda form: F.exists(form["fields"], lambda f: T.any_word(f["label"], words)))
    links = F.size(F.filter(dom["links"], lambda x: T.any_word(x["text"], words)))
    return T.any_word(dom["title"], words).cast("int") + (in_body >= 2).cast("int") + labels.cast("int") + (links >= 2).cast("int")


def form_evidence(dom: Column, url: Column, page: Column, profile: Profile) -> Column:
    """Evidence array of the form, iframe, link and portal rules; one item for each form, iframe or link that a rule hits."""
    facts = F.struct(U.parts(url)["host"].alias("host"), brand_signals(dom, page, profile).alias("signals"))
    return let(facts, lambda own: _form_evidence(dom, own["host"], own["signals"], profile))


def _form_evidence(dom: Column, host: Column, signals: Column, profile: Profile) -> Column:
    official_page = U.belongs_to(host, profile.official_domains)

    def per_form(rule_id: str, when, **more) -> Column:
        return F.transform(dom["forms"], lambda form, i: evidence(rule_id, when(form), F.concat(F.lit("form:"), i.cast("string")), **{k: v(form) for k, v in more.items()}))

    def untrusted(form: Column) -> Column:
        def reached(target: Column) -> Column:
            elsewhere = (host != "") & (U.registered_domain(target) != U.registered_domain(host))
            return (target != "") & ~U.belongs_to(target, profile.official_domains) & (elsewhere | official_page | (signals >= 1))

        return has_password(form) & let(U.parts(form["target"])["host"], reached)

    def forbidden(form: Column) -> Column:
        """Whether the form goes to a trusted service, the first that its target belongs to, and has a field that the service must not ask for."""
        has = lambda words: F.exists(form["fields"], lambda f: F.lower(f["type"]).isin(*words) | T.any_word(_searched(f), words))
        if not profile.trusted_services:
            return F.lit(False)
        target = lambda host: F.coalesce(*[F.when(U.belongs_to(host, domains), has([w.lower() for w in no]) if no else F.lit(False)) for _, domains, _, no in profile.trusted_services], F.lit(False))
        return let(U.parts(form["target"])["host"], target)

    valuable = lambda form: has_word(form, HIGH_VALUE)
    items = [
        per_form("HTML_PASSWORD_INPUT", has_password),
        F.array(evidence("HTML_PASSWORD_INPUT", (F.size(dom["forms"]) == 0) & dom["loose_password"], "page:0")),
        per_form("PASSWORD_FORM_UNTRUSTED_TARGET", untrusted),
        per_form("FORM_NON_HTTPS_ACTION", lambda form: F.lower(form["action"]).startswith("http://")),
        per_form("FORM_COLLECTS_SENSITIVE_INFO", lambda form: has_word(form, SENSITIVE)),
        per_form("TRUSTED_SERVICE_FORBIDDEN_FIELD", forbidden),
        per_form(
            "FORM_COLLECTS_SECRET",
            lambda form: (has_word(form, SECRET) | has_password(form)) & ~forbidden(form),
            severity=lambda form: F.when(valuable(form), "high").otherwise("low"),
            base=lambda form: F.when(valuable(form), 28).otherwise(5),
            confidence=lambda form: F.when(valuable(form), 0.92).otherwise(0.50),
        ),
        F.transform(dom["iframes"], lambda src: evidence("IFRAME_LOGIN_PAGE", T.any_word(src, profile.login_words), "page:0")),
        F.transform(dom["links"], lambda x: evidence("LINK_TEXT_HREF_MISMATCH", mismatch(x, host, profile), "page:0")),
        F.array(evidence("PORTAL_BRAND_EXTERNAL_DOMAIN", ~official_page & (signals >= 2), "page:0")),
    ]
    return F.array_compact(F.concat(*items))


def mismatch(link: Column, host: Column, profile: Profile) -> Column:
    """Whether a link's text shows an official domain and its address leads to another one."""
    shown = F.lit(False)
    for d in profile.official_domains:
        shown = shown | F.lower(link["text"]).contains(d)

    def elsewhere(reached: Column) -> Column:
        other = F.lit(False)
        for d in profile.official_domains:
            other = other | (reached != U.registered_domain(F.lit(d)))
        return (reached != "") & other

    own = let(U.parts(link["href"])["host"], lambda h: F.when(h == "", host).otherwise(h))
    return shown & let(let(own, U.registered_domain), elsewhere)


def page_form_evidence(page: Column, url: Column, profile: Profile) -> Column:
    return let(flattened(page, url), lambda dom: form_evidence(dom, url, page, profile))
