"""Text functions, as Column to Column.

White space is what JavaScript calls so: the ASCII blanks, the no-break space and the other Unicode
spaces. Lengths are code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

#: Fixed value: white space, for use inside a character class.
WS = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
SPACE = f"[{WS}]"
#: The same characters one by one; looking them up is much faster than that class of a pattern.
BLANKS = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Fixed value: what ends a sentence in either script.
STOP = ".!?।"


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.btrim(F.regexp_replace(F.translate(c, BLANKS, " " * len(BLANKS)), "  +", " "))


def title_tokens(title: Column, keep_marks: bool = False, least: int = 3) -> Column:
    """The distinct words of a headline of at least ``least`` characters.

    Marks count as blanks unless kept, which splits Devanagari words at their vowel signs.
    """
    kept = r"\p{L}\p{N}" + (r"\p{M}" if keep_marks else "") + WS
    plain = F.regexp_replace(F.lower(title), f"[^{kept}]", " ")
    return F.array_distinct(F.filter(F.split(plain, f"{SPACE}+"), lambda w: F.length(w) >= least))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(F.coalesce(c, F.lit(""))) == 0, "").when(F.length(c) <= n, c).otherwise(F.concat(trim(F.substring(c, 1, n)), F.lit("…")))


def _last_space(c: Column) -> Column:
    """0-based place of the last space, -1 if there is none."""
    return F.when(F.locate(" ", F.reverse(c)) == 0, -1).otherwise(F.length(c) - F.locate(" ", F.reverse(c)))


def excerpt(c: Column, most: int = 2500, floor: float = 0.55) -> Column:
    """The text up to its last sentence end within ``most`` characters, if that leaves enough; else up to the last space, else cut."""

    def of(t: Column) -> Column:
        head = F.substring(t, 1, most)
        upto = F.regexp_extract(head, f"(?s)^(.*[{STOP}]){SPACE}", 1)
        space = _last_space(head)
        cut = F.when(space > most * floor, F.substring(head, F.lit(1), space)).otherwise(head)
        return F.when(F.length(t) <= most, t).otherwise(let(upto, lambda u: F.when(F.length(u) >= most * floor, trim(u)).otherwise(F.concat(trim(cut), F.lit("…")))))

    return let(trim(c), of)


def is_longer(c: Column, most: int = 2500) -> Column:
    return F.length(trim(c)) > most


def normal_breaks(c: Column) -> Column:
    """Trimmed; line ends as \\n, at most one empty line, one blank in a row."""
    t = F.replace(trim(c), F.lit("\r\n"), F.lit("\n"))
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " ")


def hard_truncate(c: Column, most: int = 1100) -> Column:
    """Like ``excerpt``, for summaries: a sentence end may also be the cut itself, and marks before the cut go."""
    half = most // 2

    def of(t: Column) -> Column:
        head = F.substring(t, 1, most)
        upto = F.regexp_extract(head, f"(?s)^(.*[{STOP}])(?:{SPACE}|$)", 1)
        space = _last_space(head)
        safe = F.when(space > half, F.substring(head, F.lit(1), space)).otherwise(head)
        short = F.concat(F.regexp_replace(trim(safe), r"[,;:\-–—]+$", ""), F.lit("…"))
        return F.when(F.length(t) <= most, t).otherwise(let(upto, lambda u: F.when(F.length(u) >= half, trim(u)).otherwise(short)))

    return let(normal_breaks(c), of)


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(trim(c), f"(?<=[{STOP}]){SPACE}+"), trim), lambda s: s != "")


def paragraphs(c: Column, most: int = 3, short: int = 280) -> Column:
    """A text in at most ``most`` groups of sentences of about the same number; a short one stays whole."""
    empty = F.array().cast("array<string>")

    def grouped(s: Column) -> Column:
        size = F.ceil(F.size(s) / most).cast("int")
        groups = F.filter(F.array(*[trim(F.array_join(F.slice(s, F.lit(i) * size + 1, size), " ")) for i in range(most)]), lambda g: g != "")
        return F.when(F.size(s) <= most, s).otherwise(groups)

    def of(t: Column) -> Column:
        return F.when(F.coalesce(t, F.lit("")) == "", empty).when(F.length(t) < short, F.array(t)).otherwise(let(sentences(t), lambda s: F.when(F.size(s) <= 1, F.array(t)).otherwise(grouped(s))))

    return let(trim(c), of)


def words(c: Column) -> Column:
    return F.filter(F.split(trim(c), f"{SPACE}+"), lambda w: w != "")


def count_words(c: Column) -> Column:
    """Pieces between white space that hold a letter or a digit."""
    return F.size(F.filter(F.split(c, f"{SPACE}+"), lambda w: w.rlike(r"[\p{L}\p{N}]")))


def reading_minutes(c: Column, rate: int = 200) -> Column:
    n = F.size(F.split(trim(c), f"{SPACE}+"))
    return F.when(F.coalesce(c, F.lit("")) == "", 1).otherwise(F.greatest(F.lit(1), F.floor(n / rate + 0.5).cast("int")))


def monogram(name: Column) -> Column:
    """Two letters for an outlet: the initials of its first two words, an article in front aside."""
    w = F.filter(F.split(F.regexp_replace(name, f"[^\\p{{L}}\\p{{N}}{WS}]", " "), f"{SPACE}+"), lambda x: x != "")
    w = F.when(F.get(w, F.lit(0)).rlike("(?i)^(the|la|le|el)$"), F.slice(w, 2, 1000)).otherwise(w)
    first, second = F.get(w, F.lit(0)), F.get(w, F.lit(1))
    return F.when(first.isNull(), "?").when(second.isNull(), F.upper(F.substring(first, 1, 2))).otherwise(F.upper(F.concat(F.substring(first, 1, 1), F.substring(second, 1, 1))))


def relative_time(at: Column, lang: Column, now: Column) -> Column:
    """How long ago, in words; ``at`` and ``now`` in seconds."""
    minutes = F.greatest(F.lit(0), F.floor((now - at) / 60)).cast("long")
    hours, days = F.floor(minutes / 60).cast("long"), F.floor(minutes / 1440).cast("long")
    said = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    nepali = F.when(minutes < 1, "भर्खरै").when(minutes < 60, said(minutes, " मिनेट अघि")).when(hours < 24, said(hours, " घण्टा अघि")).otherwise(said(days, " दिन अघि"))
    english = F.when(minutes < 1, "Just now").when(minutes < 60, said(minutes, " min ago")).when(hours == 1, "1 hour ago").when(hours < 24, said(hours, " hours ago")).when(days == 1, "Yesterday").otherwise(said(days, " days ago"))
    return F.when(lang == "np", nepali).otherwise(english)


def escape_markup(c: Column, apostrophe: str = "&#39;") -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", apostrophe)):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def space_after_danda(c: Column) -> Column:
    return F.regexp_replace(c, f"।([^{WS}])", "। $1")


#: Pitches, wire notes and labels that are cut out of a description, in this order.
FEED_BOILERPLATE = [
    r"(?i)(?:account\s+)?subscription benefits[\s\S]*?unlock these with subscription",
    r"(?i)\bunlock these with subscription\b",
    r"(?i)\b(?:to continue reading|continue reading|read more at|sign up (?:to|for)|subscribe (?:to|now)|already a subscriber)\b[^.]*\.?",
    r"(?i)\bthis (?:article|story) (?:first )?appeared (?:first )?on\b[^.]*\.?",
    r"(?i)\bpublished\s*[-–—]\s*\w+\s+\d{1,2},\s*\d{4}\s*[\d:]*\s*(?:am|pm|ist|utc|npt)?\b",
    r"(?i)(?:©|\bcopyright)\s*\d{4}[^.]*\.?",
    r"(?i)\ball rights reserved\.?",
    r"(?i)^\s*(?:shorts news|video|watch|live|premium|exclusive)\s*:\s*",
]
#: Fixed value: signs of a page that asks for a subscription or consent instead of telling the story.
PAGE_BOILERPLATE = r"(?i)unlock these with subscription|subscription benefits|already a subscriber|to continue reading|sign up (?:to|for) (?:our|the)|all rights reserved|logout and login|premium stories|subscribe to continue|create a free account|newsletter signup|accept (?:all )?cookies|manage preferences"
#: Fixed value: labels of widgets in front of a paragraph.
WIDGET = rf"(?i)^(?:shares?|tweet|share this|follow us|advertisement|listen to this article){SPACE}+(?={'[^' + WS + ']'})"


#: What a text holds, in lower case, that any of those but the last could match.
FEED_SIGNS = ["subscri", "unlock these", "continue reading", "read more at", "sign up", "appeared", "published", "©", "copyright", "rights reserved"]


def strip_boilerplate(c: Column) -> Column:
    """The text without pitches and labels, on one line; patterns run only over texts with a sign of them."""
    low = F.lower(c)
    sign = c.rlike(FEED_BOILERPLATE[-1])
    for word in FEED_SIGNS:
        sign = sign | F.contains(low, F.lit(word))
    out = c
    for p in FEED_BOILERPLATE:
        out = F.regexp_replace(out, p, " ")
    return squeeze(F.when(sign, out).otherwise(c))


def is_boilerplate(c: Column) -> Column:
    return c.rlike(PAGE_BOILERPLATE)


def is_navigation(c: Column) -> Column:
    """No sentence end, or more than 40 words to each."""
    ends = F.regexp_count(c, F.lit(f"[{STOP}]"))
    return (ends == 0) | (F.size(F.split(c, f"{SPACE}+")) / F.greatest(F.lit(1), ends) > 40)


def echoes_title(title: Column, text: Column) -> Column:
    """Whether the text is the headline, or that and fewer than a dozen characters more."""
    bare = F.struct(*[F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", "").alias(n) for x, n in ((title, "t"), (text, "c"))])
    return let(bare, lambda b: (b["t"] != "") & (b["c"] != "") & ((b["c"] == b["t"]) | (b["c"].startswith(b["t"]) & (F.length(b["c"]) - F.length(b["t"]) < 12))))


def standfirst(title: Column, description: Column, least: int = 40) -> Column:
    """What a description says beyond its headline, or nothing."""
    given = F.struct(trim(F.coalesce(title, F.lit(""))).alias("t"), strip_boilerplate(trim(F.coalesce(description, F.lit("")))).alias("b"))

    def of(x: Column) -> Column:
        t, body = x["t"], x["b"]
        rest = F.regexp_replace(F.substring(body, F.length(t) + 1, F.lit(1 << 30)), f"^[{WS}.:;,–—-]+", "")
        said = F.when((t != "") & F.lower(body).startswith(F.lower(t)), rest).otherwise(body)
        return let(said, lambda s: F.when((F.length(s) < least) | echoes_title(t, s), "").otherwise(s))

    return let(given, of)


def script_counts(c: Column) -> tuple[Column, Column, Column]:
    """Devanagari characters, Latin letters, and all letters."""
    return F.regexp_count(c, F.lit(r"[\x{0900}-\x{097F}]")), F.regexp_count(c, F.lit("[A-Za-z]")), F.regexp_count(c, F.lit(r"\p{L}"))


def in_language(c: Column, lang: Column) -> Column:
    """Whether most letters are of the language's script; texts under 8 characters are in none."""

    def of(t: Column) -> Column:
        d, l, _ = script_counts(t)
        counts = F.struct(d.alias("d"), l.alias("l"))
        return (F.length(t) >= 8) & let(counts, lambda n: (n["d"] + n["l"] > 0) & F.when(lang == "np", n["d"] > n["l"]).otherwise(n["l"] > n["d"]))

    return let(normal_breaks(c), of)


def summary_bounds(lang: Column) -> tuple[Column, Column]:
    """The lengths a summary may have."""
    return F.when(lang == "np", 840).otherwise(760), F.when(lang == "np", 1210).otherwise(1100)


def is_verbatim(c: Column, lang: Column) -> Column:
    low, high = summary_bounds(lang)
    return F.length(c).between(low, high)


def shown_text(item: str, lang: Column) -> Column:
    """struct(title, summary) in the reader's language, if there is a translation; ``item`` is the rows' alias."""
    c = lambda n: F.col(f"{item}.{n}")
    own = (c("original_lang") == lang) | (F.coalesce(c("title_translated"), F.lit("")) == "")
    translated = F.struct(c("title_translated").alias("title"), F.coalesce(c("summary_translated"), F.lit("")).alias("summary"))
    return F.when(own, F.struct(c("title").alias("title"), c("summary").alias("summary"))).otherwise(translated)


#: What topics are called.
TOPIC_NAMES = {
    "breaking": ("Breaking", "ताजा"), "politics": ("Politics", "राजनीति"), "world": ("World", "विश्व"), "business": ("Business", "अर्थतन्त्र"), "sports": ("Sports", "खेलकुद"),
    "technology": ("Tech", "प्रविधि"), "health": ("Health", "स्वास्थ्य"), "environment": ("Environment", "वातावरण"), "society": ("Society", "समाज"),
}


def topic_label(topic: Column, lang: Column) -> Column:
    """What a topic is called in the reader's language; null if there is no such topic."""
    called = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for t, names in TOPIC_NAMES.items() for x in (t, names[i])]), topic)
    return F.when(lang == "np", called(1)).otherwise(called(0))


def lang_attr(lang: Column) -> Column:
    """The language as markup names it."""
    return F.when(lang == "np", "ne").otherwise("en")


def lang_name(lang: Column) -> Column:
    return F.when(lang == "np", "Nepali").otherwise("English")


def subscriber_lang(value: Column) -> Column:
    """The language that a reader's stored wish means."""
    return F.when(value == "np", "np").otherwise("en")
