"""Word lists and rules. Results depend on them; all are arguments where they are used."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query stop words.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would should could may might shall need "
    "want get tell show give find know help please can about at by for with against between into through before after "
    "above below to from up down in out on off over under of and or but so if this that these those it its "
    "we our your you he she they their i my me us what how when where which who all any some also like "
    "just really very quite much many more most than then hi hello hey thanks thank ok okay sure yes no not"
).split()

#: Stop words of chunk keywords.
CHUNK_STOP_WORDS = (
    "a an the is are was were be been have has had do does will would should could may might in of "
    "to for with on at by from that this and or but it its as if then so no not also can all any"
).split()

#: Stop words of page keywords.
PAGE_STOP_WORDS = (
    "a an the is are was were be been have has had do does did will would should could may might at by for with about "
    "to from in on of and or but so if this that it its we our you they their i me us what how when where which "
    "who all some not no also can get very more most than then such other each any many under over up here there as into "
    "through before after out just per via must both own same too"
).split()

#: Many words to one, for queries.
SYNONYMS = {
    "register": "registration", "registering": "registration", "registered": "registration",
    "incorporate": "incorporation", "incorporating": "incorporation", "incorporated": "incorporation",
    "file": "filing", "filed": "filing", "form": "filing", "companies": "company", "startups": "startup",
    "taxation": "tax", "taxes": "tax", "gstin": "gst", "trademarks": "trademark", "brand": "trademark", "brands": "trademark",
    "licensing": "license", "licenses": "license", "licensed": "license", "comply": "compliance", "complying": "compliance", "compliant": "compliance",
    "audits": "audit", "litigat": "litigation", "disputes": "dispute", "document": "documents", "docs": "documents",
    "cost": "fees", "price": "fees", "charges": "fees", "time": "timeline", "days": "timeline", "duration": "timeline",
}

#: Section types by the first word found in the section's name.
SECTION_TYPES = [
    ("introduction", "intro"), ("overview", "intro"), ("about", "intro"), ("document", "requirements"), ("required", "requirements"),
    ("eligibility", "requirements"), ("process", "process"), ("step", "process"), ("procedure", "process"), ("benefit", "benefits"),
    ("advantage", "benefits"), ("feature", "benefits"), ("faq", "faq"), ("question", "faq"), ("contact", "contact"), ("reach", "contact"),
    ("price", "pricing"), ("fee", "pricing"), ("cost", "pricing"), ("penalty", "legal"), ("compliance", "legal"), ("law", "legal"), ("regulation", "legal"),
]
TYPE_BOOSTS = {"requirements": 0.2, "faq": 0.25, "process": 0.15, "pricing": 0.2, "legal": 0.1, "intro": 0.05}

#: Page types by the first pattern found in the URL's path, second generation; and first generation.
PAGE_TYPES = [
    ("service", ["/service"]), ("blog", ["/blog", "/post", "/article", "/news"]), ("faq", ["/faq", "/help"]), ("contact", ["/contact"]),
    ("legal", ["/terms", "/privacy", "/disclaimer"]), ("about", ["/about"]), ("team", ["/team", "/people", "/attorney", "/advocate"]),
    ("practice", ["/practice", "/expertise"]), ("careers", ["/career", "/join"]),
]
PAGE_TYPES_V1 = [
    ("service", ["/services/", "/service/"]), ("blog", ["/blog/", "/post/", "/article/", "/news/"]), ("faq", ["/faq", "/faqs", "/help"]),
    ("contact", ["/contact", "/reach-us", "/get-in-touch"]), ("legal", ["/legal", "/terms", "/privacy", "/disclaimer"]),
    ("industry", ["/industry/", "/sector/"]), ("about", ["/about"]), ("home", ["/"]),
]
SKIPPED_EXTENSIONS = "pdf jpg jpeg png gif svg webp zip mp4 mp3 css js woff woff2 ttf ico map".split()

#: Elements that aren't content, by tag, class and id.
NOISE_TAGS = ("script", "style", "noscript", "iframe", "nav", "footer")
NOISE_CLASSES = ("cookie-banner", "popup", "modal", "ad", "advertisement", "footer", "header-nav", "mobile-menu", "social-links", "social-icons")
NOISE_IDS = ("cookie", "footer")
#: E-mail addresses and telephone numbers.
EMAIL, PHONE = r"[\w.+-]+@[\w-]+\.[a-zA-Z]{2,}", r"\+?\d[\d\s\-().]{7,}\d"

#: Topics and their terms, for a knowledge base on business law.
INTENTS = [
    ("gst", ["gst", "goods and services tax", "gstin", "gst registration", "gstr"]),
    ("tax", ["tax", "income tax", "itr", "tds", "advance tax", "tax filing"]),
    ("trademark", ["trademark", "brand", "logo", "ip", "intellectual property", "copyright"]),
    ("startup", ["startup", "new company", "entrepreneur", "founder", "incubation"]),
    ("company_incorporation", ["company", "private limited", "llp", "opc", "incorporation", "mca"]),
    ("compliance", ["compliance", "annual filing", "roc", "statutory", "audit"]),
    ("licensing", ["license", "fssai", "shop act", "msme", "udyam", "iec", "import export"]),
    ("advisory", ["advice", "legal advice", "consult", "consultation", "guidance"]),
    ("litigation", ["litigation", "court", "dispute", "case", "legal action", "arbitration"]),
    ("contact", ["contact", "reach", "support", "help", "phone", "email", "address"]),
]
#: Topics for texts in the test tables' invented languages.
SAMPLE_INTENTS = [
    ("english", ["the", "of the", "this"]), ("french", ["les", "des", "de la"]), ("german", ["der", "die", "und"]),
    ("spanish", ["los", "las", "que"]), ("threads", ["thread", "thre", "on the"]), ("notes", ["ing and", "nd", "er"]),
]
GREETINGS = ["hi", "hello", "hey", "greetings", "good morning", "good afternoon", "hi there", "hello there", "sup"]
FAQ_OPENERS = "how|what|why|when|where|which|can|do|does|is|are|will|should|who"
#: Lines that are navigation and not content.
NOISE_LINES = [
    "skip to main content", "top of page", "back to top", "home", "about us", "insights & resources", "insights and resources", "practices areas", "practice areas",
    "people", "careers", "contact", "all articles", "court rulings", "updates", "communique", "follow us", "share", "like", "read more", "view all",
    "privacy policy", "terms of use", "all rights reserved", "disclaimer", "min read", "cookie policy",
]
NOISE_PATTERN = r"(?i)^([0-9]+\s+min\s+read|[A-Z][a-z]+ [0-9]+,? [0-9]{4}|Updated:.*|[A-Z][a-z]+ [0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}|www\.\S+|Tel:\s*\+?[0-9\s\-()]+)$"
HEADING_PATTERN = (
    r"^([IVX]{1,5}\.\s+\S.{2,100}|[0-9]{1,2}\.\s+[A-Z]\S.{2,100}|[A-Z][A-Z ]{5,70}[A-Z]"
    r"|(?:Introduction|Background|Facts|Issue|Analysis|Held|Ratio|Order|Judgment|Decision|Conclusion|Summary|Overview|Appeal Mechanism|Penalty"
    r"|Adjudication|Investigation|Complaint|Final Order|Observations?|Implications?)[:\s]?)$"
)


def words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def case_contains(column: Column, rules: list[tuple[str, str | list[str]]], default: str | Column, swapped: bool = False) -> Column:
    """The label of the first rule with a part that the column contains. Rules are (part, label), or (label, parts) if swapped."""
    out = None
    for a, b in rules:
        label, parts = (a, b) if swapped else (b, [a])
        test = F.lit(False)
        for part in parts:
            test = test | F.contains(column, F.lit(part))
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(default)


# The same as SQL text.


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def sql_values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(quoted(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"


def sql_case(column: str, rules: list[tuple], default: str, swapped: bool = False, quote: bool = True) -> str:
    parts = []
    for a, b in rules:
        label, found = (a, b) if swapped else (b, [a])
        parts.append("WHEN " + " OR ".join(f"contains({column}, {quoted(p)})" for p in found) + f" THEN {quoted(label)}")
    return "CASE " + " ".join(parts) + f" ELSE {quoted(default) if quote else default} END"


def sql_map(pairs: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in pairs.items()) + "}"
