"""Anchors of pages, with the texts and images around them, by DataFrame functions alone.

A page is cut into tags and texts by one pattern and becomes a row a token; everything else is windows over a page's tokens.  A card is an
``li``, ``article`` or ``div``; the innermost card that is open at a token is found from running depths, one for each of these
names, so an element that is never closed does not shift the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import exprs as E

#: Comments, scripts and styles whole; a tag, in whose quotes an angle bracket may stand; a text; an angle bracket that opens nothing.
TOKEN = r"""(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|</?[a-z](?:[^>"']+|"[^"]*"|'[^']*')*>|[^<]+|<"""
CARDS = ("li", "article", "div")
#: Texts of a card that count.
CARD_TEXTS = 16
IMAGE_SOURCES = ("data-src", "data-original", "src")


def attribute(tag: Column | str, name: str) -> Column:
    """An attribute's value, in either quotes or bare; null if it is absent or empty."""
    pattern = rf"""(?is)[\s"']{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    tag = F.col(tag) if isinstance(tag, str) else tag
    return E.unescape_html(F.coalesce(*(F.nullif(F.regexp_extract(tag, pattern, k), F.lit("")) for k in (1, 2, 3))))


def tokens(pages: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, kind, tag, token) of the tokens that say something: tags of cards, anchors and images, and texts that are not blank."""
    cut = pages.select(*keys, F.posexplode(F.regexp_extract_all("html", F.lit(TOKEN), F.lit(0))).alias("pos", "token"))
    name = F.lower(F.regexp_extract("token", r"(?i)^</?([a-z][a-z0-9]*)", 1))
    text = F.trim(E.unescape_html("token"), F.lit(" \t\r\n\f\v"))
    is_text = ~F.col("token").startswith("<")
    told = cut.select(
        *keys, "pos", name.alias("tag"), F.when(is_text, "text").when(F.col("token").startswith("</"), "close").otherwise("open").alias("kind"),
        F.when(is_text, text).otherwise(F.col("token")).alias("token"),
    )
    closes = F.col("tag").isin(*CARDS, "a")
    return told.filter(((F.col("kind") == "text") & (F.col("token") != "")) | closes | ((F.col("tag") == "img") & (F.col("kind") == "open")))


def anchors(pages: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, href, alt, title_attr, text, cover, card) of each anchor with an address, ``pos`` from 0 in the order of the page.

    ``text`` joins the anchor's texts by spaces; ``alt`` and ``cover`` are of its images, the latter, where it has none, of the card around it; ``card`` holds the card's
    first texts.  Values that are absent are null, the card's texts none.
    """
    t = tokens(pages, *keys)
    here = W.partitionBy(*keys).orderBy("pos")
    upto = here.rowsBetween(W.unboundedPreceding, W.currentRow)
    later = W.partitionBy(*keys).orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, W.currentRow)
    is_open = F.col("kind") == "open"
    image = (F.col("tag") == "img") & is_open
    address = attribute("token", "href")
    sources = (F.when(s.startswith("http"), s) for s in (attribute("token", k) for k in IMAGE_SOURCES))
    t = t.withColumns({
        "href": F.when((F.col("tag") == "a") & is_open, address), "src": F.when(image, F.coalesce(*sources)),
        "alt": F.when(image, attribute("token", "alt")), "title_attr": F.when((F.col("tag") == "a") & is_open, attribute("token", "title")),
    })
    t = t.withColumns({
        "n_texts": F.count_if(F.col("kind") == "text").over(upto), "anchor": F.count("href").over(upto),
        "inside": F.last(F.when(F.col("href").isNotNull(), True).when((F.col("tag") == "a") & (F.col("kind") == "close"), False), ignorenulls=True).over(upto),
        "next_src": F.last(F.when(F.col("src").isNotNull(), F.struct("pos", "src")), ignorenulls=True).over(later),
        **{f"depth_{c}": F.sum(F.when(F.col("tag") == c, F.when(is_open, 1).otherwise(-1)).otherwise(0)).over(upto) for c in CARDS},
    })
    following = W.partitionBy(*keys).orderBy("n_texts").rangeBetween(1, CARD_TEXTS)
    t = t.withColumn("next_texts", F.collect_list(F.when(F.col("kind") == "text", F.struct("pos", "token"))).over(following))
    t = t.withColumn("next_texts", F.transform(F.array_sort("next_texts"), lambda x: x["token"]))
    around = []
    for c in CARDS:
        own = F.col("tag") == c
        closing = own & (F.col("kind") == "close")
        # A closing tag stands on the level that it ends.
        t = t.withColumn(f"level_{c}", F.col(f"depth_{c}") + F.when(closing, 1).otherwise(0))
        level = W.partitionBy(*keys, f"level_{c}")
        ends = F.last(F.when(closing, F.struct("pos", "n_texts")), ignorenulls=True).over(level.orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, W.currentRow))
        t = t.withColumn("end", ends)
        held = F.struct(F.col("pos").alias("start"), F.col("end.pos").alias("end"), "n_texts", F.col("end.n_texts").alias("end_texts"), "next_texts", "next_src")
        t = t.withColumn(f"card_{c}", F.last(F.when(own & is_open, held), ignorenulls=True).over(level.orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)))
        around.append(F.col(f"card_{c}"))
    inner = F.array_max(F.filter(F.array(*around), lambda x: x.isNotNull())).alias("inner")
    t = t.select(*keys, "pos", "kind", "token", "href", "alt", "title_attr", "src", "anchor", "inside", F.when(F.col("href").isNotNull(), inner).alias("inner"))
    own = F.col("href").isNotNull()
    texts = F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("pos", "token"))))
    each = t.filter("inside").groupBy(*keys, "anchor").agg(
        *(F.max(F.when(own, F.col(c))).alias(c) for c in ("href", "title_attr")), F.max("inner").alias("inner"),
        F.min_by("alt", F.when(F.col("alt").isNotNull(), F.col("pos"))).alias("alt"), F.min_by("src", F.when(F.col("src").isNotNull(), F.col("pos"))).alias("src"),
        F.array_join(F.transform(texts, lambda x: x["token"]), " ").alias("text"),
    )
    within = F.col("inner.end").isNull() | (F.col("inner.next_src.pos") < F.col("inner.end"))
    held = F.coalesce(F.col("inner.end_texts") - F.col("inner.n_texts"), F.lit(CARD_TEXTS))
    none = F.array().cast("array<string>")
    return each.select(
        *keys, (F.col("anchor") - 1).cast("int").alias("pos"), "href", "alt", "title_attr", "text",
        F.coalesce("src", F.when(within, F.col("inner.next_src.src"))).alias("cover"),
        F.coalesce(F.slice("inner.next_texts", F.lit(1), F.least(held, F.lit(CARD_TEXTS)).cast("int")), none).alias("card"),
    )
