"""HTML: entities, text, meta tags, structured data, paragraphs and pictures of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binding import let
from .text import WIDGET, is_boilerplate, is_navigation, space_after_danda, squeeze, trim

#: Between texts that are decoded together.
GLUE = "\x1e"

#: Entities by name, with what each stands for.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ensp": " ", "emsp": " ", "thinsp": " ", "shy": "",
    "zwj": "\u200d", "zwnj": "\u200c", "lrm": "\u200e", "rlm": "\u200f", "wj": "\u2060", "ndash": "-", "mdash": " - ", "hellip": "…",
    "lsquo": "'", "rsquo": "'", "sbquo": "'", "ldquo": '"', "rdquo": '"', "bdquo": '"', "laquo": "«", "raquo": "»", "bull": "•", "middot": "·",
    "deg": "°", "copy": "©", "reg": "®", "trade": "™", "euro": "€", "pound": "£", "yen": "¥", "cent": "¢", "sect": "§", "para": "¶",
    "dagger": "†", "permil": "‰", "prime": "′", "Prime": "″", "times": "×", "divide": "÷", "minus": "−", "plusmn": "±",
    "frac12": "½", "frac14": "¼", "frac34": "¾", "hearts": "♥", "rarr": "→", "larr": "←", "harr": "↔",
    "eacute": "é", "egrave": "è", "agrave": "à", "ccedil": "ç", "uuml": "ü", "ouml": "ö", "auml": "ä", "szlig": "ß", "ntilde": "ñ",
    "aacute": "á", "iacute": "í", "oacute": "ó", "uacute": "ú",
}
#: Fixed value: an entity, by number or by name.
ENTITY = "&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});"


def _character(code: Column) -> Column:
    """The character of a number, or a space if it is none that can be shown."""
    bad = (code <= 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF) | ((code < 32) & (code != 9) & (code != 10))
    return F.when(bad, " ").otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def _decoded(piece: Column) -> Column:
    body = F.substring(piece, F.lit(2), F.length(piece) - 2)
    number = F.when(F.substring(body, 2, 1).isin("x", "X"), F.conv(F.substring(body, 3, 6), 16, 10)).otherwise(F.substring(body, 2, 7)).try_cast("long")
    names = F.create_map(*[F.lit(x) for kv in ENTITIES.items() for x in kv])
    named = F.coalesce(F.try_element_at(names, body), F.try_element_at(names, F.lower(body)), piece)
    return F.when(~piece.startswith("&") | (F.length(piece) < 3), piece).when(piece.startswith("&#"), _character(number)).otherwise(named)


def decode_entities(c: Column) -> Column:
    """Entities by name and by number become characters, twice over; unknown names stay, numbers of no character become spaces."""

    def once(t: Column) -> Column:
        pieces = F.regexp_extract_all(t, F.lit(f"({ENTITY}|[^&]+|&)"), F.lit(1))
        return F.when(t.rlike(ENTITY), F.array_join(F.transform(pieces, _decoded), "")).otherwise(t)

    return F.when(c.contains("&"), let(once(c), once)).otherwise(c)


def strip_tags(c: Column) -> Column:
    """Tags, styles, scripts and comments become a space each, so that no words grow together."""
    return F.regexp_replace(F.regexp_replace(c, r"(?is)<style[^>]*>.*?</style>|<script[^>]*>.*?</script>|<!--.*?-->", " "), r"<[^>]+>", " ")


def to_text(c: Column) -> Column:
    """What a reader sees of markup, on one line."""
    return squeeze(decode_entities(strip_tags(c)))


def clean_for_display(c: Column) -> Column:
    return to_text(decode_entities(F.coalesce(c, F.lit(""))))


def meta_tags(html: Column) -> Column:
    """array<struct<key, content>> of a page's meta tags, as "property:..." or "name:..."; of equal keys the first."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<meta\b([^>]*)>"), F.lit(1))
    attr = lambda tag, name: F.regexp_extract(tag, rf"(?i)(?:^|[\s\"'])(?:{name})\s*=\s*[\"']([^\"']*)[\"']", 1)

    def one(tag: Column) -> Column:
        prop, name = attr(tag, "property"), attr(tag, "name")
        return F.struct(F.when(prop != "", F.concat(F.lit("property:"), F.lower(prop))).when(name != "", F.concat(F.lit("name:"), F.lower(name))).alias("key"), attr(tag, "content").alias("content"))

    return F.filter(F.transform(tags, one), lambda m: m["key"].isNotNull() & (m["content"] != ""))


def raw_content(meta: Column, key: str) -> Column:
    """The first meta tag's content of that key as it stands; '' if there is none."""
    return F.coalesce(F.get(F.filter(meta, lambda m: m["key"] == key), F.lit(0))["content"], F.lit(""))


def meta_content(meta: Column, key: str) -> Column:
    """Text of the first meta tag with that key, decoded and without markup; '' if there is none."""
    return clean_for_display(raw_content(meta, key))


def json_ld_body(html: Column, blocks: int = 12, size: int = 200_000) -> Column:
    """The longest articleBody or description in the page's first structured data blocks, also below @graph or in a list."""
    found = F.slice(F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1)), 1, blocks)
    node = "struct<articleBody: string, description: string>"

    def texts(block: Column) -> Column:
        one = F.from_json(block, f"struct<articleBody: string, description: string, `@graph`: array<{node}>>")
        many = F.from_json(block, f"array<{node}>")
        nodes = F.concat(F.array(F.struct(one["articleBody"].alias("articleBody"), one["description"].alias("description"))), F.coalesce(one["@graph"], F.array().cast(f"array<{node}>")), F.coalesce(many, F.array().cast(f"array<{node}>")))
        return F.flatten(F.transform(nodes, lambda x: F.array(x["articleBody"], x["description"])))

    all_ = F.flatten(F.transform(F.filter(found, lambda b: F.length(b) <= size), texts))
    return _longest(F.transform(F.array_compact(all_), lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))


def _longest(sized: Column) -> Column:
    """The text of the longest struct<n, t>, the first of equals; ''."""
    best = F.aggregate(sized, F.struct(F.lit(0).alias("n"), F.lit("").alias("t")), lambda a, x: F.when(x["n"] > a["n"], x).otherwise(a))
    return best["t"]


def raw_paragraphs(html: Column, scan: int = 250_000) -> Column:
    """The contents of the page's paragraphs, without markup but not decoded."""
    return F.transform(F.regexp_extract_all(F.substring(html, 1, scan), F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1)), strip_tags)


def running_text(paragraphs: Column, least: int = 120, most: int = 6000) -> Column:
    """Decoded paragraphs of running text joined, until they are more than ``most`` characters."""
    text = F.transform(paragraphs, lambda p: F.regexp_replace(squeeze(p), WIDGET, ""))
    text = F.filter(text, lambda p: (F.length(p) >= least) & ~is_navigation(p) & ~is_boilerplate(p))
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("ps"))
    taken = F.aggregate(text, start, lambda a, p: F.when(a["n"] > most, a).otherwise(F.struct((a["n"] + F.length(p) + 1).alias("n"), F.concat(a["ps"], F.array(p)).alias("ps"))))
    return trim(F.array_join(taken["ps"], " "))


def paragraph_text(html: Column) -> Column:
    """The page's paragraphs of running text."""
    return running_text(F.split(decode_entities(F.array_join(raw_paragraphs(html), GLUE)), GLUE))


def best_of(ladder: Column, paragraphs: Column, most: int = 6000) -> Column:
    """struct(text, via): the best account of an article, null if none is long enough.

    ``ladder`` is array<struct<via, text>>, best kind first. The first substantial one wins; else the
    longer of the paragraphs and the first usable one; else the longest, called og.
    """
    told = lambda text, via: F.struct(F.substring(text, 1, most).alias("text"), via.alias("via"))
    first = lambda least: F.get(F.filter(ladder, lambda x: F.length(x["text"]) >= least), F.lit(0))

    def choose(x: Column) -> Column:
        good, usable, longest, p = x["good"], x["usable"], x["longest"], x["p"]
        return F.coalesce(
            F.when(good.isNotNull(), told(good["text"], good["via"])),
            F.when((F.length(p) >= 120) & (F.length(p) > F.coalesce(F.length(usable["text"]), F.lit(0))), told(p, F.lit("paragraphs"))),
            F.when(usable.isNotNull(), told(usable["text"], usable["via"])),
            F.when(F.length(longest) >= 60, told(longest, F.lit("og"))),
        )

    longest = _longest(F.transform(ladder, lambda x: F.struct(F.length(x["text"]).alias("n"), x["text"].alias("t"))))
    return let(F.struct(first(600).alias("good"), first(120).alias("usable"), longest.alias("longest"), paragraphs.alias("p")), choose)


def absolute(u: Column, site: Column) -> Column:
    """An address of a page made absolute; null unless it is https then."""
    full = F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(u.startswith("/") & (site != ""), F.concat(site, u)).otherwise(u)
    return F.when(full.rlike(r"^https://[^/]+"), full)


#: Where a page tells its text and its picture, best first.
TEXT_KEYS = [("og", "property:og:description"), ("meta", "name:description"), ("twitter", "name:twitter:description")]
IMAGE_KEYS = ["property:og:image", "property:og:image:url", "name:twitter:image", "name:twitter:image:src"]


def parse_articles(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """The pages with text, via and image_url in place of their HTML; pages with neither text nor picture are left out.

    All that has to be decoded of a page is decoded as one string, twice, as the contents of meta
    tags may hold markup that is escaped itself.
    """
    keys = [k for _, k in TEXT_KEYS] + IMAGE_KEYS
    t = pages.withColumn("_m", meta_tags(F.col(html))).withColumn("_ld", json_ld_body(F.col(html))).withColumn("_p", raw_paragraphs(F.col(html)))
    t = t.withColumn("_raw", F.array_join(F.array(*[raw_content(F.col("_m"), k) for k in keys]), GLUE)).drop(html, "_m")
    t = t.withColumn("_once", F.transform(F.split(decode_entities(F.col("_raw")), GLUE), strip_tags))
    t = t.withColumn("_all", F.split(decode_entities(F.array_join(F.concat("_once", "_p"), GLUE)), GLUE)).drop("_raw", "_once", "_p")
    n = len(keys)
    said = lambda i: squeeze(F.get("_all", F.lit(i)))
    ladder = F.array(F.struct(F.lit("jsonld").alias("via"), F.col("_ld").alias("text")), *[F.struct(F.lit(v).alias("via"), said(i).alias("text")) for i, (v, _) in enumerate(TEXT_KEYS)])
    site = F.regexp_extract(url, r"^(https://[^/?#]+)", 1)
    images = F.coalesce(*[absolute(said(len(TEXT_KEYS) + i), site) for i in range(len(IMAGE_KEYS))])
    found = F.struct(best_of(ladder, running_text(F.slice("_all", n + 1, 1 << 20))).alias("b"), images.alias("i"))

    def result(x: Column) -> Column:
        b = x["b"]
        return F.struct(F.coalesce(space_after_danda(b["text"]), F.lit("")).alias("text"), F.coalesce(b["via"], F.lit("og")).alias("via"), x["i"].alias("image_url"), (b.isNotNull() | x["i"].isNotNull()).alias("any"))

    # exploded, not filtered: a filter would be pushed below and work everything out again
    kept = [c for c in pages.columns if c != html]
    out = t.select(*kept, F.explode(F.filter(F.array(let(found, result)), lambda r: r["any"])).alias("_r"))
    return out.select(*kept, "_r.text", "_r.via", "_r.image_url")
