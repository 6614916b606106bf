"""Topics, markers of breaking news, addresses of readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binding import let

#: Topics in the order in which they win ties, each with English words and Nepali stems.
TOPIC_WORDS = {
    "sports": ("cricket football soccer olympic olympics world_cup tournament match goal striker fifa icc nba nfl tennis wicket innings medal athlete marathon championship league volleyball badminton sprint", "खेल क्रिकेट फुटबल ओलम्पिक खेलाडी प्रतियोगिता गोल पदक विश्वकप टोली"),
    "health": ("hospital vaccine vaccination outbreak epidemic pandemic disease virus dengue cholera malaria covid patients surgery doctors healthcare clinic mental_health nutrition cancer infection who", "स्वास्थ्य अस्पताल खोप महामारी रोग बिरामी उपचार डेंगु संक्रमण औषधि"),
    "environment": ("climate glacier monsoon flood landslide earthquake wildfire pollution emissions deforestation biodiversity wildlife conservation drought air_quality everest himalaya himalayan carbon renewable solar", "जलवायु वातावरण बाढी पहिरो भूकम्प प्रदूषण हिमाल हिमताल वन जंगल वन्यजन्तु मनसुन खडेरी"),
    "technology": ("artificial_intelligence ai software startup semiconductor chip smartphone internet cyber cybersecurity data_breach app google apple microsoft openai satellite spacecraft digital algorithm crypto bitcoin robot 5g", "प्रविधि इन्टरनेट मोबाइल डिजिटल साइबर सफ्टवेयर कृत्रिम_बुद्धिमत्ता"),
    "business": ("economy economic inflation gdp budget tax trade export import market markets stock shares investors investment bank banking rupee dollar revenue tariff remittance loan interest_rate imf world_bank fiscal profit merger tourism", "अर्थतन्त्र बजेट कर व्यापार बजार शेयर बैंक लगानी मुद्रास्फीति राजस्व निर्यात आयात रेमिट्यान्स पर्यटन आर्थिक"),
    "politics": ("election elections parliament minister prime_minister president cabinet government coalition party lawmakers senate congress vote voters policy bill constitution diplomacy sanctions ambassador protest impeachment referendum opposition mayor governor treaty", "राजनीति निर्वाचन संसद मन्त्री प्रधानमन्त्री राष्ट्रपति सरकार मन्त्रिपरिषद दल गठबन्धन मतदान संविधान अध्यादेश सांसद विपक्षी कूटनीति"),
    "society": ("school schools university students education teachers women children caste migrant migration labour labor poverty welfare crime police court arrest trafficking rights community village housing festival film movie cinema music concert album art artist museum heritage literature novel poet theatre theater dance temple tradition actor actress exhibition award", "समाज विद्यालय विश्वविद्यालय विद्यार्थी शिक्षा शिक्षक महिला बालबालिका प्रहरी अदालत पक्राउ अपराध गरिबी श्रमिक अधिकार समुदाय संस्कृति चाडपर्व पर्व दशैं तिहार फिल्म चलचित्र संगीत कला कलाकार साहित्य मन्दिर सम्पदा परम्परा नृत्य"),
    "world": ("united_nations nato war ceasefire conflict refugees border military troops airstrike summit global international foreign bilateral gaza ukraine russia china india washington beijing brussels delhi", "अन्तर्राष्ट्रिय विश्व युद्ध शरणार्थी सीमा सेना वार्ता विदेश संयुक्त_राष्ट्र"),
}
#: The topic that an outlet's category stands for.
CATEGORY_TOPIC = dict(x.split(":") for x in "politics:politics government:politics policy:politics breaking:breaking business:business markets:business economics:business development:business society:society street:society world:world conflict:world europe:world asia:world china:world india:world wire:world national:politics".split())
#: Fixed value: markers of breaking news in a headline.
BREAKING = r"(?i)(?<![A-Za-z0-9_])(?:breaking|just in|live updates?|developing)(?![A-Za-z0-9_])|ताजा अपडेट|भर्खरै"
ACCEPT = 4
#: What an address looks like, and domains of throwaway inboxes.
EMAIL = r'^[^\s@,;:<>()\[\]\\"]+@[^\s@,;:<>()\[\]\\".]+(\.[^\s@,;:<>()\[\]\\".]+)+$'
DISPOSABLE = "mailinator.com guerrillamail.com 10minutemail.com tempmail.com temp-mail.org throwawaymail.com yopmail.com trashmail.com getnada.com sharklasers.com maildrop.cc dispostable.com".split()


def topic_patterns() -> dict[str, tuple[str, str]]:
    """For each topic the words as an alternation, and the stems as one."""
    return {t: ("|".join(w.replace("_", " ") for w in en.split()), "|".join(w.replace("_", " ") for w in np_.split())) for t, (en, np_) in TOPIC_WORDS.items()}


def _hits(text: Column, words: Column, native: Column, en: str, np_: str) -> Column:
    """2 for an English word and 2 for a Nepali stem; the text is in lower case, ``words`` its ASCII words, ``native`` whether it has Devanagari at all."""
    single = [w for w in en.split() if "_" not in w]
    phrases = [w.replace("_", " ") for w in en.split() if "_" in w]
    hit = F.arrays_overlap(words, F.array(*[F.lit(w) for w in single]))
    for p in phrases:  # a phrase is looked for as such first, its ends only where it stands
        hit = hit | (F.contains(text, F.lit(p)) & text.rlike(f"(?<![a-z0-9_]){p}(?![a-z0-9_])"))
    stem = F.lit(False)
    for w in np_.split():
        stem = stem | F.contains(text, F.lit(w.replace("_", " ")))
    return F.when(hit, 2).otherwise(0) + F.when(native & stem, 2).otherwise(0)


def _facts(text: Column) -> tuple[Column, Column]:
    return F.split(text, "[^a-z0-9_]+"), text.rlike(r"[\x{0900}-\x{097F}]")


def _choice(t: tuple[Column, Column, Column], s: tuple[Column, Column, Column], categories: Column) -> Column:
    scores = [F.struct((_hits(*t, *w) * 2 + _hits(*s, *w)).alias("score"), F.lit(-i).alias("place"), F.lit(name).alias("topic")) for i, (name, w) in enumerate(TOPIC_WORDS.items())]
    mapping = F.create_map(*[F.lit(x) for kv in CATEGORY_TOPIC.items() for x in kv])
    mapped = F.get(F.filter(F.transform(F.coalesce(categories, F.array().cast("array<string>")), lambda c: F.try_element_at(mapping, F.lower(c))), lambda x: x.isNotNull()), F.lit(0))
    return let(F.array_max(F.array(*scores)), lambda b: F.when(b["score"] >= ACCEPT, b["topic"]).otherwise(F.coalesce(mapped, F.when(b["score"] > 0, b["topic"]), F.lit("world"))))


def with_topic(df: DataFrame, name: str, title: Column, summary: Column, categories: Column) -> DataFrame:
    """The rows with a topic: the one with the highest score if that is enough, else the outlet's first mapped category, else the best topic, else world.

    A headline counts twice; of equal scores the topic named first wins. What is looked at is worked
    out in columns first, so that all of it stays in generated code.
    """
    t = df.withColumn("_t", F.lower(F.coalesce(title, F.lit("")))).withColumn("_s", F.lower(F.coalesce(summary, F.lit(""))))
    for n in ("_t", "_s"):
        for i, f in enumerate(_facts(F.col(n))):
            t = t.withColumn(f"{n}{i}", f)
    t = t.withColumn(name, _choice(*[(F.col(n), F.col(f"{n}0"), F.col(f"{n}1")) for n in ("_t", "_s")], categories))
    return t.drop("_t", "_s", "_t0", "_t1", "_s0", "_s1")


def is_breaking(title: Column) -> Column:
    return F.coalesce(title.rlike(BREAKING), F.lit(False))


def email_problem(raw: Column) -> Column:
    """Why an address is refused: empty, too-long, shape or disposable; null if it isn't."""
    e = F.lower(F.trim(raw))
    domain = F.regexp_extract(e, "@([^@]*)$", 1)
    return F.when(F.coalesce(e, F.lit("")) == "", "empty").when(F.length(e) > 254, "too-long").when(~e.rlike(EMAIL), "shape").when(domain.isin(DISPOSABLE), "disposable")


def mask_email(e: Column) -> Column:
    """The first letter, up to five bullets, and the domain."""
    at = F.length(e) - F.length(F.substring_index(e, "@", -1))
    bullets = F.repeat(F.lit("•"), F.least(at - 2, F.lit(5)).cast("int"))
    return F.when((F.locate("@", e) == 0) | (at < 2), "•••").otherwise(F.concat(F.substring(e, 1, 1), bullets, F.substring(e, at, F.lit(1000))))
