"""Rule catalogues: detectors, header rules, policy, roles, responder wording.

Everything here is data.  Adding a detector, a header rule or a policy row means
adding an entry; operators take the catalogue as a parameter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# --- fixed values: sensitivity tiers -----------------------------------------
TIER_RANK = {"restricted": 3, "confidential": 2, "internal": 1}
RANK_TIER = {rank: tier for tier, rank in TIER_RANK.items()}


@dataclass(frozen=True)
class Detector:
    """One text rule. ``value_group`` 1 means "group 1 if it took part, else the whole match"."""

    type: str
    cls: str
    sensitivity: str
    label: str
    pattern: str
    ignore_case: bool = False
    value_group: int = 0
    check: str | None = None
    gate: str | None = None  # a shared necessary condition, see GATES
    literals: tuple[str, ...] = ()  # a text without any of them is not searched
    # The same matches for Java where the pattern repeats a group without limit: Java
    # recurses per repetition, possessive repetition does not.
    java: str | None = None
    # The same matches in linear time where the pattern may start anywhere in a long run:
    # start only where a run starts (``lead``) or where the last match ended, then ``body``.
    lead: str | None = None
    body: str | None = None

    @property
    def group(self) -> int:
        return 1 if self.lead else self.value_group

    def java_regex(self) -> str:
        if self.lead:
            return java_pattern(rf"(?:\G(?!\A)|{self.lead})({self.body})")
        return java_pattern(self.java or self.pattern, self.ignore_case)


# An address starts at the first word character of a run of local-part characters.
EMAIL_LEAD = r"(?<![A-Za-z0-9._%+-])[.%+-]*+(?=\w)"
EMAIL_BODY = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"


# --- fixed values: detector patterns (ASCII \b \w \d, whitespace as in ECMAScript) ---
DETECTORS: tuple[Detector, ...] = (
    Detector(
        "PAN", "payment-card", "restricted", "Payment card (PAN)",
        r"\b(?:\d[ -]?){13,19}\b", check="luhn", gate="digits",
    ),
    Detector(
        "QID", "national-id", "restricted", "Qatar ID (QID)", r"\b[23]\d{10}\b", gate="digits",
    ),
    Detector(
        "IBAN", "bank-account", "restricted", "IBAN / bank account",
        r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", check="iban_country", gate="iban",
    ),
    Detector(
        "PASSPORT", "national-id", "restricted", "Passport number", r"\b[A-PR-WY][0-9]{7,8}\b", gate="digits",
    ),
    Detector(
        "SECRET", "credential", "restricted", "API key / credential",
        r"\b(?:sk-[A-Za-z0-9]{20,}|ghp_[A-Za-z0-9]{36}|AKIA[0-9A-Z]{16}"
        r"|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})\b", gate="secret",
    ),
    Detector(
        "MRN", "health", "restricted", "Medical record / diagnosis",
        r"\b(?:MRN[:#]?\s*\d{5,}|diagnos(?:is|ed)\s+(?:with\s+)?[A-Za-z][A-Za-z\s'-]{2,40})",
        ignore_case=True, gate="health",
    ),
    Detector(
        "EMAIL", "contact", "confidential", "Email address",
        r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", gate="at",
        lead=EMAIL_LEAD, body=EMAIL_BODY,
    ),
    Detector(
        "PHONE", "contact", "confidential", "Phone number",
        r"(?:\+974[\s-]?)?\b\d{3,4}[\s-]?\d{4}\b|\+\d{1,3}[\s-]?(?:\d[\s-]?){6,12}\d",
        check="seven_digits", gate="digits",
    ),
    Detector(
        "NAME", "identity", "confidential", "Person name",
        r"\b(?:Mr|Mrs|Ms|Miss|Dr|Sheikh|Sheikha|Eng)\.?\s+[A-Z][a-z]+(?:[\s-][A-Z][a-z]+){0,3}"
        r"|\b(?:[Cc]ustomer|[Pp]atient|[Cc]lient|[Aa]pplicant|[Mm]ember|[Cc]itizen)"
        r"\s+([A-Z][a-z]+(?:[\s-][A-Z][a-z]+){1,3})",
        value_group=1, gate="titles",
    ),
    Detector(
        "DOB", "identity", "confidential", "Date of birth",
        r"\b(?:DOB|date of birth|born)\b[:\s]*\d{1,4}[\/.\-]\d{1,2}[\/.\-]\d{1,4}",
        ignore_case=True, gate="birth",
    ),
    Detector(
        "ADDR", "location", "confidential", "Street address",
        r"\b(?:Villa|Building|Bldg|Apt|Apartment|Street|St\.|Zone|Flat)\s+[\w,\s-]{3,40}\b",
        ignore_case=True, gate="address",
    ),
)

@dataclass(frozen=True)
class Gate:
    """A cheap necessary condition: one of the literals, then the patterns in turn.

    Literal search is far cheaper than a pattern.  Patterns start with a plain character
    class, which Java skips fast; equal first patterns are tested once per text.
    """

    literals: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()


_ANCHOR_WORD = (
    r"[AaBbDdFfMmSsVvZz](?<!\w.)"
    r"(?i:illa|uilding|ldg|pt|partment|treet|t\.|one|lat|rn|iagnos|ob|ate of birth|orn)"
)

GATES: dict[str, Gate] = {
    "digits": Gate(patterns=(r"[0-9](?:[\s-]?[0-9]){6}",)),
    "dotted": Gate(patterns=(r"[0-9]\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]",)),
    "iban": Gate(patterns=(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11}",)),
    "secret": Gate(literals=("sk-", "ghp_", "AKIA", "eyJ")),
    "health": Gate(patterns=(_ANCHOR_WORD, r"[MmDd](?<!\w.)(?i:rn|iagnos)")),
    "birth": Gate(patterns=(_ANCHOR_WORD, r"[DdBb](?<!\w.)(?i:ob|ate of birth|orn)[^A-Za-z]")),
    "address": Gate(
        patterns=(
            _ANCHOR_WORD,
            r"[AaBbFfSsVvZz](?<!\w.)(?i:illa|uilding|ldg|pt|partment|treet|t\.|one|lat)\s",
        )
    ),
    "titles": Gate(
        literals=(
            "Mr", "Ms", "Miss", "Dr", "Sheikh", "Eng", "ustomer", "atient", "lient", "pplicant", "ember", "itizen",
        ),
        patterns=(
            r"(?:[MDSE](?<!\w.)(?:rs?|s|iss|heikha?|ng)|[CPAMcpam](?<!\w.)(?:ustomer|atient|lient|pplicant|ember|itizen))"
            r"\.?\s+[A-Z][a-z]",
        ),
    ),
    "at": Gate(literals=("@",)),
}

# --- fixed values: country codes an IBAN may start with ----------------------
IBAN_COUNTRIES = ("QA", "AE", "SA", "BH", "KW", "OM", "GB", "DE", "FR")

# --- fixed values: types masked word by word ---------------------------------
WORD_MASKED_TYPES = ("NAME", "ADDR", "MRN", "DOB")

# --- fixed values: screening profile -----------------------------------------
SCREENING: tuple[Detector, ...] = (
    Detector(
        "EMAIL", "", "confidential", "Email",
        r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", ignore_case=True, gate="at",
        lead=EMAIL_LEAD, body=EMAIL_BODY,
    ),
    Detector("SSN", "", "restricted", "SSN", r"\b\d{3}-\d{2}-\d{4}\b", gate="digits"),
    Detector("CARD", "", "restricted", "Card", r"\b(?:\d[ -]*?){13,16}\b"),
    Detector(
        "IP", "", "confidential", "IP", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", check="octets", gate="dotted",
    ),
    Detector(
        "PHONE", "", "confidential", "Phone",
        r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b",
    ),
    Detector(
        "PERSON", "", "confidential", "Person",
        r"\b[A-Z][a-z]+(?:\s[A-Z][a-z]+)+\b", check="not_ui_phrase",
        java=r"\b[A-Z][a-z]+(?:\s[A-Z][a-z]++(?!\w))++",
    ),
)
# Stop phrases of two words; a PERSON value always has two words, so one-word
# stop phrases can never match and are left out.
NOT_PERSONS = ("new chat", "security copilot")
WARNING_WORDS = r"phishing|malware|ransomware|breach|exfiltration"

# --- fixed values: column header rules, first match wins ---------------------
HEADER_RULES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("NAME", "Customer name", ("name", "customer", "client", "full name", "الاسم", "العميل")),
    ("QID", "Qatar ID (QID)", ("qid", "qatar id", "national id", "id no", "id number", "البطاقة", "الرقم الشخصي")),
    ("IBAN", "IBAN / account", ("iban", "account", "acct", "account no", "account number", "رقم الحساب")),
    ("PAN", "Card number", ("card", "pan", "card no", "card number", "البطاقة الائتمانية")),
    ("EMAIL", "Email", ("email", "e-mail", "mail", "بريد")),
    ("PHONE", "Phone", ("phone", "mobile", "tel", "contact no", "هاتف", "جوال")),
    ("PASSPORT", "Passport", ("passport", "جواز")),
    ("ADDR", "Address", ("address", "villa", "zone", "street", "عنوان")),
    ("DOB", "Date of birth", ("dob", "date of birth", "birth", "الميلاد")),
)
FINANCE_HINTS = {
    "days_past_due": ("days past due", "dpd", "overdue", "days overdue", "past due"),
    "debt": ("outstanding", "loan", "debt", "balance", "exposure", "owed", "principal"),
    "income": ("salary", "income", "monthly salary", "wage"),
}

# --- fixed values: destination policy ----------------------------------------
DEFAULT_DESTINATION = "sovereign-local"
EXTERNAL_DESTINATION = "external-cloud"
POLICY: tuple[tuple[str, str, str], ...] = (
    ("sovereign-local", "restricted", "allow"),
    ("sovereign-local", "confidential", "allow"),
    ("sovereign-local", "internal", "allow"),
    ("sovereign-local", "none", "allow"),
    ("external-cloud", "restricted", "require-approval"),
    ("external-cloud", "confidential", "allow"),
    ("external-cloud", "internal", "allow"),
    ("external-cloud", "none", "allow"),
)
NEVER_EXTERNAL = ("credential",)
STATUS_OF_DECISION = {"block": "blocked", "require-approval": "pending", "allow": "completed"}

# --- fixed values: roles -----------------------------------------------------
ROLE_RANK = {"admin": 40, "operator": 30, "auditor": 20, "viewer": 10}

# --- fixed values: risk tiers ------------------------------------------------
TIER_RULES: tuple[tuple[str, int, str], ...] = (
    ("High risk", 0, "90+ days past due, or debt-to-annual-income ≥ 0.6"),
    ("Medium risk", 1, "30–89 days past due, or debt-to-annual-income 0.35–0.6"),
    ("Low risk", 2, "current, or low debt-to-income"),
)
UNCLASSIFIED = "Unclassified"
GROUPING_HEADLINE = "Customers grouped into credit-risk tiers by days-past-due and debt-to-income."
DRAFT_WORDS = (
    "draft", "write", "reply", "respond", "message", "messages", "reminder", "letter",
    "email", "notice", "outreach", "correspond", "notify",
)
CHAT_PROVIDERS = ("sovereign", "openai", "anthropic", "ollama")

GENESIS = "0" * 64
LOCK_WINDOW_SECONDS = 15 * 60
LOCK_THRESHOLD = 5
SESSION_IDLE_HOURS = 24

# --- fixed values: ECMAScript white space, as it stands inside a character class ---
SPACE_CHARS = "\t\n\x0b\x0c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE = f"[{SPACE_CHARS}]"

# A word boundary under ASCII rules; Java's own \b follows Unicode.
_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def _starts_with_word_char(rest: str) -> bool:
    rest = re.sub(r"^(?:\(\?:)+", "", rest)
    plain_class = re.match(r"\[([A-Za-z0-9-]+)\]", rest)
    return bool(plain_class) or rest.startswith(r"\d") or rest[:1].isalnum()


def java_pattern(pattern: str, ignore_case: bool = False) -> str:
    r"""Spell a catalogue pattern for Java: explicit ASCII ``\b`` and explicit ``\s``."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two == r"\s":
            out.append(SPACE_CHARS if in_class else SPACE)
        elif two == r"\b":
            out.append(r"(?<!\w)" if _starts_with_word_char(pattern[i + 2:]) else _EDGE)
        elif two[0] == "\\":
            out.append(two)
        else:
            in_class = (in_class or two[0] == "[") and two[0] != "]"
            out.append(two[0])
            i -= 1
        i += 2
    return ("(?i)" if ignore_case else "") + "".join(out)


# --- fixed values: policy reasons --------------------------------------------
REASON_BLOCKED_CLASS = ('Data class "', '" may never leave the perimeter — blocked before any model call.')
REASON_APPROVAL = " data is leaving the perimeter to an external model — a human approver is required."
REASON_NOT_PERMITTED = " data is not permitted at this destination."
REASON_SOVEREIGN = "Sovereign destination — request stays in-country and proceeds with redaction."
REASON_PERMITTED = " data permitted to external model in redacted form."

# --- fixed values: offline responder, gateway wording ------------------------
OFFLINE_PROVIDER = "sovereign-echo"
OFFLINE_MODEL = "local-demo"
GATEWAY_INTENTS = {
    "dispute": r"dispute|chargeback|fraud|unauthor",
    "summary": r"summar|explain|what[^\n\r]*say|review",
    "eligibility": r"eligib|approve|loan|credit|apply|application",
}
GATEWAY_REPLIES = {
    "dispute": "Draft response — transaction dispute:\n"
               "Dear {who}, thank you for flagging this. I have opened a dispute case for the transaction you referenced{card}.\n"
               "Our fraud team will review and respond within 2 business days. No further action is needed from you at this time.",
    "summary": "Summary of the request:\n"
               "The message concerns {who}{others}. The core intent appears to be a service or account inquiry.\n"
               "Recommended next step: confirm identity through an approved channel before sharing any account detail.",
    "eligibility": "Assessment draft:\n"
                   "Based on the information provided for {who}, the application can proceed to standard verification. "
                   "Confirm income documents and run the usual checks before a decision.",
    "other": "Acknowledged. I have read the request regarding {who}.\n"
             "{fields}\n"
             "Tell me what you'd like drafted or checked next and I'll continue.",
}
GATEWAY_OTHERS = (" and references ", " other sensitive field(s)")
GATEWAY_FIELDS = ("It references the following protected fields, which remain redacted end-to-end: ", ".")
GATEWAY_NO_FIELDS = "No sensitive fields were detected."
GATEWAY_NOBODY = "the customer"

# --- fixed values: offline responder, chat wording ---------------------------
CHAT_INTENTS = {
    "dispute": r"dispute|chargeback|fraud|unauthor",
    "summary": r"summar|explain|review|what[^\n\r]*mean",
    "draft": r"draft|write|email|reply|letter|message",
    "eligibility": r"eligib|loan|credit|approve|apply|assess",
}
CHAT_REPLIES = {
    "dispute": "Hi {who}, I've drafted a response for the disputed transaction{card}. "
               "A case has been opened and the fraud team will follow up within 2 business days.",
    "summary": "Here's a short summary: the message concerns {who}{others}. Tell me what angle you'd like and I'll go deeper.",
    "draft": "Draft for {who}:\n\n"
             "Thank you for getting in touch. We've received your request and will get back to you shortly with the next steps.",
    "eligibility": "Based on the details for {who}, the request can proceed to standard verification. "
                   "Confirm the supporting documents and run the usual checks before deciding.",
    "other": "Got it{regarding}. {fields}How would you like me to help?",
}
CHAT_OTHERS = (" and ", " other protected field(s)")
CHAT_FIELDS = ("I can see ", " protected field(s) (", ") which stay redacted end-to-end. ")
CHAT_NOBODY = "there"

# --- fixed values: letter templates ------------------------------------------
LETTER_EN = (
    "Dear {id},\n\nThis is a courteous reminder that your account currently shows an outstanding balance of QAR {amount}{late}. "
    "Kindly arrange payment at your earliest convenience, or contact us so we can discuss suitable options. "
    "Thank you for banking with us."
)
LETTER_EN_LATE = ", now {days} days past due"
LETTER_AR = (
    "عزيزي {id}،\n\nنذكّركم بلطف بوجود رصيد مستحق على حسابكم بقيمة {amount} ريال قطري{late}. "
    "نرجو منكم ترتيب السداد في أقرب وقت ممكن، أو التواصل معنا لمناقشة الخيارات المناسبة. شكراً لتعاملكم معنا."
)
LETTER_AR_LATE = "، ومتأخر الآن {days} يوماً"
NO_NAME = "Customer"
REMINDER_WORDS = r"remind|overdue|collect|due"
PREVIEW_ROWS = 12

# --- fixed values: prompt texts around the redacted rows ---------------------
GROUPING_HEAD = (
    "You are a bank analyst assistant. Below is a customer table where IDENTITY\n"
    "values have been replaced with placeholders like [NAME_1], [QID_1], [IBAN_1].\n"
    "The financial figures are real. Do NOT guess or reconstruct any placeholder —\n"
    "keep them VERBATIM in your output so they can be restored locally.\n"
    "\n"
    "TABLE (CSV):\n"
)
GROUPING_TASK = (
    "Group these customers into Low / Medium / High credit-risk tiers based on days past due, outstanding loan "
    "and income. Summarise each tier."
)
GROUPING_TAIL = (
    "\n\nRespond with ONLY valid JSON, no prose, in this exact shape:\n"
    '{ "headline": "one sentence", "groups": [ { "tier": "High risk", "rule": "why these belong here", '
    '"members": ["[NAME_1]", "[NAME_4]"], "summary": "1-2 sentence summary" } ] }'
)
DRAFT_HEAD = (
    "You are a bank customer-communications assistant. Below are customers whose\n"
    "identities are redacted as placeholders like [NAME_1], [IBAN_1], [QID_1].\n"
    "Keep every placeholder VERBATIM — never guess, translate, or expand them.\n"
    "\n"
    "CUSTOMERS (CSV):\n"
)
DRAFT_TASK = "Draft a short, polite payment-reminder message for each customer."
DRAFT_TAIL = (
    "\nWrite each message in BOTH English and Modern Standard Arabic. Keep it concise,\n"
    "professional and compliant; greet the customer using their [NAME_x] placeholder.\n\n"
    'Respond with ONLY valid JSON: { "drafts": [ { "id": "[NAME_1]", "en": "…", "ar": "…" } ] }'
)
