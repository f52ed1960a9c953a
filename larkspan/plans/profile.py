"""Rule definitions, scoring parameters and word lists, as one immutable profile.

Lists of domains and words belong to a deployment: a profile is an argument of every
operator. ``DEMO`` fits the synthetic tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields

# Rule id, group, severity, base score, confidence.
RULES = (
    ("URL_IP_DOMAIN", "transport", "medium", 12, 0.80),
    ("URL_SHORT_LINK", "navigation", "medium", 8, 0.70),
    ("URL_NON_HTTPS", "transport", "low", 6, 0.30),
    ("URL_SUSPICIOUS_PORT", "transport", "low", 5, 0.50),
    ("URL_LONG_SUBDOMAIN", "identity", "medium", 8, 0.65),
    ("URL_AT_SYMBOL", "navigation", "high", 20, 0.90),
    ("URL_NESTED_OFFICIAL_DOMAIN", "identity", "high", 22, 0.90),
    ("DOMAIN_SIMILAR_TO_OFFICIAL", "identity", "high", 25, 0.90),
    ("DOMAIN_PUNYCODE_SUSPICIOUS", "identity", "high", 28, 0.95),
    ("DOMAIN_HOMOGRAPH_ATTACK", "identity", "high", 30, 1.00),
    ("DOMAIN_KEYWORD_IMPERSONATION", "identity", "medium", 12, 0.78),
    ("HTML_PASSWORD_INPUT", "credential", "low", 4, 0.90),
    ("PASSWORD_FORM_UNTRUSTED_TARGET", "credential", "high", 30, 0.95),
    ("FORM_NON_HTTPS_ACTION", "transport", "medium", 12, 0.80),
    ("FORM_COLLECTS_SENSITIVE_INFO", "credential", "medium", 12, 0.75),
    ("TRUSTED_SERVICE_FORBIDDEN_FIELD", "credential", "high", 30, 0.95),
    ("FORM_COLLECTS_SECRET", "credential", "high", 28, 0.92),
    ("META_REFRESH_REDIRECT", "navigation", "medium", 10, 0.80),
    ("JS_LOCATION_REDIRECT", "navigation", "medium", 10, 0.65),
    ("HIDDEN_FORM_OR_LINK", "navigation", "medium", 10, 0.60),
    ("IFRAME_LOGIN_PAGE", "navigation", "medium", 12, 0.75),
    ("LINK_TEXT_HREF_MISMATCH", "navigation", "high", 22, 0.90),
    ("EXTERNAL_LINK_DOMINANCE", "navigation", "medium", 12, 0.85),
    ("PORTAL_BRAND_EXTERNAL_DOMAIN", "identity", "high", 25, 0.85),
    ("URGENT_VERIFY_WORDING", "social", "medium", 8, 0.65),
    ("TIME_LIMIT_PRESSURE", "social", "medium", 10, 0.75),
    ("ACCOUNT_DISABLE_THREAT", "social", "medium", 10, 0.75),
    ("REWARD_OR_REFUND_BAIT", "social", "medium", 8, 0.65),
    ("SECURITY_UPGRADE_WORDING", "social", "low", 5, 0.55),
    ("CREDENTIAL_REQUEST_TEXT", "credential", "high", 25, 0.85),
    ("EMAIL_SENDER_IMPERSONATION", "identity", "medium", 15, 0.85),
    ("EMAIL_SENDER_LINK_MISMATCH", "identity", "medium", 12, 0.75),
    ("ATTACHMENT_EXECUTABLE", "payload", "high", 22, 0.95),
    ("ATTACHMENT_DOUBLE_EXTENSION", "payload", "high", 30, 0.95),
    ("HTML_BASE64_IMAGE_HEAVY", "payload", "medium", 10, 0.45),
    ("HTML_IMAGE_ONLY_CONTENT", "payload", "medium", 10, 0.40),
    ("QR_CODE_EXTERNAL_URL", "navigation", "medium", 10, 0.70),
    ("QR_CREDENTIAL_URL", "credential", "high", 20, 0.90),
)
# A rule takes away others on the same subject.
SUPPRESSES = (
    ("PASSWORD_FORM_UNTRUSTED_TARGET", "HTML_PASSWORD_INPUT"),
    ("PASSWORD_FORM_UNTRUSTED_TARGET", "FORM_COLLECTS_SECRET"),
    ("TRUSTED_SERVICE_FORBIDDEN_FIELD", "HTML_PASSWORD_INPUT"),
    ("TRUSTED_SERVICE_FORBIDDEN_FIELD", "FORM_COLLECTS_SECRET"),
    ("FORM_COLLECTS_SECRET", "FORM_COLLECTS_SENSITIVE_INFO"),
    ("DOMAIN_HOMOGRAPH_ATTACK", "DOMAIN_SIMILAR_TO_OFFICIAL"),
    ("DOMAIN_HOMOGRAPH_ATTACK", "DOMAIN_KEYWORD_IMPERSONATION"),
    ("DOMAIN_PUNYCODE_SUSPICIOUS", "DOMAIN_SIMILAR_TO_OFFICIAL"),
    ("LINK_TEXT_HREF_MISMATCH", "EMAIL_SENDER_LINK_MISMATCH"),
    ("TIME_LIMIT_PRESSURE", "URGENT_VERIFY_WORDING"),
    ("ATTACHMENT_DOUBLE_EXTENSION", "ATTACHMENT_EXECUTABLE"),
    ("QR_CREDENTIAL_URL", "QR_CODE_EXTERNAL_URL"),
)
# Most points of a group, factors by rank in a group, levels, qualifying confidence.
CAPS = {"identity": 35, "credential": 40, "navigation": 25, "social": 20, "transport": 15, "payload": 30}
FACTORS = (1.0, 0.5, 0.25)
LEVELS = ("low", "medium", "high", "critical")
FLOORS = (0, 30, 60, 80)
TOPS = (29, 59, 79, 100)
QUALIFIED_MEDIUM = 0.75
QUALIFIED_HIGH = 0.80
RAW_CAP = 100
MAX_BYTES = 204_800
MAX_LEVELS = 4
# Public suffixes of two labels.
TWO_PART_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.cn", "net.cn", "org.cn", "edu.cn", "gov.cn", "ac.cn", "com.au", "co.jp", "com.hk", "com.tw")
# Departments.
DEPARTMENTS = ("信息化", "信息技术中心", "网络中心", "教务处", "学生处", "财务处", "信息化工作办公室")
SECRET_PARAMETERS = ("password", "token", "code", "key", "secret", "pwd", "pass")


@dataclass(frozen=True)
class Profile:
    official_domains: tuple[str, ...] = ()
    short_links: tuple[str, ...] = ("bit.ly", "t.co", "tinyurl.com", "goo.gl", "is.gd")
    port_exceptions: tuple[tuple[str, tuple[int, ...]], ...] = ()
    brand_words: tuple[str, ...] = ()
    #: Departments that a message may claim to come from.
    department_words: tuple[str, ...] = DEPARTMENTS
    login_words: tuple[str, ...] = ("login", "signin", "verify", "account", "auth", "password")
    wording: dict[str, tuple[str, ...]] = field(default_factory=dict)
    #: A character and the text it is taken for; without any, a skeleton is the text itself.
    confusables: tuple[tuple[str, str], ...] = ()
    #: Services of others: name, domains, fields that their forms may ask for, and fields that they may not.
    trusted_services: tuple[tuple[str, tuple[str, ...], tuple[str, ...], tuple[str, ...]], ...] = ()
    dangerous_extensions: tuple[str, ...] = ("exe", "scr", "js", "vbs", "bat", "cmd", "ps1", "jar", "msi", "hta", "lnk")

    def __post_init__(self):
        unknown = set(self.wording) - {r[0] for r in RULES}
        if unknown:
            raise ValueError(f"wording for unknown rules: {sorted(unknown)}")
        if any(len(source) != 1 for source, _ in self.confusables):
            raise ValueError("a confusable source is one character")
        if any(d != d.lower() or d.startswith(".") for d in (*self.official_domains, *self.short_links)):
            raise ValueError("domains are written in lower case, without a leading dot")


DEMO = Profile(
    official_domains=("example.org",),
    short_links=("example.net",),
    port_exceptions=(("m.example.com", (8080,)),),
    brand_words=("the", "ing"),
    department_words=("tion", "heit"),
    trusted_services=(("survey", ("example.net",), ("email",), ("password", "token")),),
    login_words=("login", "page", "ref"),
    wording={
        "URGENT_VERIFY_WORDING": ("verify", "worthless"),
        "TIME_LIMIT_PRESSURE": ("within", "when"),
        "ACCOUNT_DISABLE_THREAT": ("disable", "hate"),
        "REWARD_OR_REFUND_BAIT": ("refund", "with of"),
        "SECURITY_UPGRADE_WORDING": ("upgrade", "only on"),
        "CREDENTIAL_REQUEST_TEXT": ("password", "secret"),
    },
)

# What the wording rules look for, names of sign-in pages, and services that shorten addresses.
WORDING = {
    "URGENT_VERIFY_WORDING": ("立即验证", "马上认证", "立即认证", "马上验证", "请尽快验证", "速验证"),
    "TIME_LIMIT_PRESSURE": ("小时内", "今日内", "24小时", "12小时", "48小时", "今日截止", "过期"),
    "ACCOUNT_DISABLE_THREAT": ("账号停用", "账号冻结", "账号关闭", "账户停用", "账户冻结", "停用账号", "禁用账号", "注销账号"),
    "REWARD_OR_REFUND_BAIT": ("奖学金", "补贴", "退款", "领取", "助学", "助学金", "补助金", "退费"),
    "SECURITY_UPGRADE_WORDING": ("安全升级", "异常登录", "安全中心", "安全验证", "账号保护", "身份验证"),
    "CREDENTIAL_REQUEST_TEXT": ("请回复密码", "发送验证码", "输入银行卡", "提交密码", "填写密码", "验证码到"),
}
LOGIN_WORDS = ("login", "auth", "verify", "登录", "认证", "验证", "signin", "统一身份", "portal", "cas")
SHORT_LINKS = ("bit.ly", "t.cn", "url.cn", "dwz.cn", "suo.im", "shorturl.at")

#: The standard lists; official domains, brand words and trusted services belong to a deployment and are put in by it.
STANDARD = Profile(wording=WORDING, login_words=LOGIN_WORDS, short_links=SHORT_LINKS)


def profile_of(settings: dict) -> Profile:
    """A profile from settings as a configuration file has them (lists for tuples, mappings for pairs). Unknown names are an error."""
    known = {f.name for f in fields(Profile)}
    if unknown := set(settings) - known:
        raise ValueError(f"unknown settings: {sorted(unknown)}")

    def frozen(value):
        return tuple(frozen(v) for v in value) if isinstance(value, list | tuple) else value

    plain = {k: {r: tuple(w) for r, w in v.items()} if k == "wording" else tuple((a, frozen(b)) for a, b in v.items()) if isinstance(v, dict) else frozen(v) for k, v in settings.items()}
    return Profile(**plain)


def suppressions(settings: dict[str, list | dict]) -> list[tuple[str, str, bool]]:
    """(source, target, everywhere) of a suppression map: a bare list of targets holds for the same subject."""
    out = []
    for source, entry in settings.items():
        entry = {"suppresses": entry, "scope": "subject"} if isinstance(entry, list) else entry
        if entry.get("scope", "subject") not in ("subject", "global"):
            raise ValueError(f"{source}: unknown scope")
        out += [(source, target, entry.get("scope") == "global") for target in entry["suppresses"]]
    return out


def checked_scoring(floors: tuple, tops: tuple, factors: tuple, caps: dict, medium: float, high: float) -> None:
    """Raise unless levels cover 0 to 100 without gap or overlap, factors fall from at most 1, caps are 1 to 100 and medium is not above high."""
    if floors[0] != 0 or tops[-1] != 100 or any(b != a + 1 for a, b in zip(tops, floors[1:])) or any(b < a for a, b in zip(floors, tops)):
        raise ValueError("levels must cover 0 to 100 without gaps")
    if any(not 0 < f <= 1 for f in factors) or list(factors) != sorted(factors, reverse=True):
        raise ValueError("factors must fall and lie in (0, 1]")
    if any(not 1 <= c <= 100 for c in caps.values()):
        raise ValueError("caps must lie in 1 to 100")
    if medium > high:
        raise ValueError("the medium threshold is above the high one")


checked_scoring(FLOORS, TOPS, FACTORS, CAPS, QUALIFIED_MEDIUM, QUALIFIED_HIGH)


def validated(rows) -> None:
    """Raise if a rule list names a rule twice, or uses unknown groups or severities."""
    ids = [r[0] for r in rows]
    if len(ids) != len(set(ids)):
        raise ValueError("a rule is defined twice")
    for _, group, severity, base, confidence in rows:
        if group not in CAPS or severity not in LEVELS[:3] or base < 0 or not 0 <= confidence <= 1:
            raise ValueError("a rule has an unknown group or severity, or a value out of range")


validated(RULES)
