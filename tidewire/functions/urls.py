"""URL parts, signatures and the classifiers, all as ordered WHEN chains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Social domains with their class.
SOCIAL = {
    "facebook.com": "facebook", "fb.com": "facebook", "m.facebook.com": "facebook", "web.facebook.com": "facebook",
    "youtube.com": "youtube", "youtu.be": "youtube", "m.youtube.com": "youtube",
    "twitter.com": "twitter", "x.com": "twitter", "t.co": "twitter", "m.twitter.com": "twitter",
    "instagram.com": "instagram", "linkedin.com": "linkedin", "tiktok.com": "tiktok",
    "pinterest.com": "pinterest", "reddit.com": "reddit", "tumblr.com": "tumblr",
}
#: Social domains of the four-bucket classifier.
SOCIAL_BUCKET = ["facebook.com", "twitter.com", "x.com", "instagram.com", "linkedin.com", "youtube.com", "youtu.be", "pinterest.com", "tiktok.com", "whatsapp.com", "t.me", "reddit.com"]
#: Shapes of news, government and school addresses, searched without case.
NEWS = [r"/noticias/", r"/news/", r"/article/", r"/articulo/", r"/noticia/", r"/politica/", r"/economia/", r"/deportes/"]
GOVERNMENT = [r"\.gob\.(pe|mx|ar|co|cl|ec|br)", r"\.gov\.", r"\.mil\.", r"/gobierno/", r"municipalidad", r"ministerio"]
EDUCATION = [r"\.edu\.", r"\.ac\.", r"universidad", r"institute", r"instituto", r"school", r"colegio", r"academy"]
#: Extensions.
DOCUMENTS = [".pdf", ".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx", ".odt", ".ods", ".odp", ".txt", ".rtf"]
IMAGES = [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".svg", ".tiff", ".ico"]
AUDIO = [".mp3", ".wav", ".ogg", ".m4a", ".flac", ".aac"]
BINARY = [".jpg", ".jpeg", ".png", ".gif", ".mp3", ".mp4", ".pdf", ".zip", ".doc", ".docx"]
IMAGE_FOLDERS = ["/images/", "/img/", "/static/images/"]
IMAGE_FOLDERS_WIDE = ["/uploads/", "/images/", "/img/", "/static/images/", "/media/"]
#: Substrings of the one-level classifier, in the order in which they are tried.
ONE_LEVEL = {
    "facebook": ["facebook.com", "fb.com", "fb.watch"],
    "youtube": ["youtube.com", "youtu.be"],
    "news": ["andina.pe", "larepublica.pe", "elperuano", "diariocorreo.pe", "rpp.pe", "infobae.com", "eltiempo.pe", "exitosanoticias.pe", "lahora.pe", "jornada.com.pe", "sinfronteras"],
    "document": [".pdf", "dispositivo", "normas", "sharepoint"],
    "image": [".jpg", ".jpeg", ".png", ".gif"],
    "media": [".mp3", ".mp4", ".avi", ".mov", ".wav"],
    "government": ["gob.pe", "sunass", "defensoria"],
}
#: Similarity thresholds by class.
THRESHOLDS = {
    ("social", "facebook"): 0.8, ("social", "youtube"): 0.9, ("social", "twitter"): 0.85, ("social", "other_social"): 0.85,
    ("html", "news"): 0.7, ("html", "government"): 0.9, ("html", "educational"): 0.85, ("html", "documents"): 0.95, ("html", "other_html"): 0.8,
    ("images", None): 0.95, ("audio", None): 0.95,
}
DEFAULT_THRESHOLD = 0.85
#: Suffixes of two labels under which names are registered; others have one label.
SUFFIXES = ["com.pe", "gob.pe", "edu.pe", "org.pe", "net.pe", "com.mx", "com.ar", "com.br", "com.co", "gob.mx", "co.uk", "ac.uk", "gov.uk", "org.uk", "com.au", "co.jp"]


def _url(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def scheme(c: Column) -> Column:
    return F.lower(F.regexp_extract(_url(c), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def netloc(c: Column) -> Column:
    """Host with port and userinfo, as it stands."""
    return F.regexp_extract(_url(c), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def path(c: Column) -> Column:
    return F.regexp_extract(_url(c), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(c: Column) -> Column:
    return F.regexp_extract(_url(c), r"^[^?#]*\?([^#]*)", 1)


def extension(c: Column) -> Column:
    """.ext of the path's last part, lower case; a part that only starts with dots has none."""
    return F.lower(F.regexp_extract(path(c), r"[^/.][^/]*(\.[^./]*)$", 1))


def is_valid(c: Column) -> Column:
    return (scheme(c) != "") & (netloc(c) != "")


def _any_in(c: Column, parts: list[str]) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | c.contains(p)
    return found


def unquoted(c: Column) -> Column:
    """%XX decoded, + kept; as it stands if the escapes are broken."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(_url(c), r"\+", "%2B")), _url(c))


def is_image(c: Column) -> Column:
    p = F.lower(path(unquoted(c)))
    return is_valid(c) & (p.rlike(r"\.(jpg|jpeg|png|gif|bmp|webp|svg|tiff|ico)$") | _any_in(p, IMAGE_FOLDERS_WIDE))


def is_social(c: Column) -> Column:
    d = F.lower(netloc(c))
    found = d.isin(SOCIAL_BUCKET)
    for s in SOCIAL_BUCKET:
        found = found | d.endswith("." + s)
    return is_valid(c) & found


def is_binary(c: Column) -> Column:
    return extension(c).isin(BINARY)


def is_facebook(c: Column) -> Column:
    return F.lower(_url(c)).contains("facebook.com") | F.lower(_url(c)).contains("fb.com")


def base_domain(host: Column) -> Column:
    """The last two labels; all of a shorter name."""
    labels = F.split(F.coalesce(host, F.lit("")), r"\.")
    return F.when(F.size(labels) < 2, host).otherwise(F.array_join(F.slice(labels, -2, 2), "."))


def signature(c: Column) -> Column:
    """netloc:part:part with digit runs as N; empty parts go."""
    parts = F.filter(F.split(path(c), "/"), lambda x: x != "")
    return F.array_join(F.concat(F.array(netloc(c)), F.transform(parts, lambda x: F.regexp_replace(x, r"\p{Nd}+", "N"))), ":")


def domain_info(c: Column) -> Column:
    """struct<subdomain, domain, suffix> by SUFFIXES."""
    labels = F.split(F.regexp_replace(F.regexp_replace(F.lower(netloc(c)), r"^.*@", ""), r":[0-9]*$", ""), r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2), ".").isin(SUFFIXES)
    n = F.when(two, 2).otherwise(1)
    at = F.size(labels) - n
    join = lambda a: F.array_join(a, ".")
    none = F.array().cast("array<string>")
    return F.struct(
        join(F.when(at > 1, F.slice(labels, F.lit(1), F.greatest(at - 1, F.lit(0)))).otherwise(none)).alias("subdomain"),
        F.when(at >= 1, F.element_at(labels, F.greatest(at, F.lit(1)))).otherwise(F.element_at(labels, 1)).alias("domain"),
        F.when(at >= 1, join(F.slice(labels, F.greatest(at, F.lit(1)) + 1, 2))).otherwise("").alias("suffix"),
    )


def _social_class(c: Column) -> Column:
    """The class of the shortest tail of two labels or more that is a social domain."""
    d = F.split(F.lower(netloc(c)), r"\.")
    found = F.lit(None).cast("string")
    for k in (4, 3, 2):
        tail = F.when(F.size(d) >= k, F.array_join(F.slice(d, -k, k), "."))
        for name, kind in SOCIAL.items():
            if name.count(".") == k - 1:
                found = F.when(tail == name, kind).otherwise(found)
    return found


def classify_two_level(c: Column) -> Column:
    """struct<category, subcategory>."""
    low, ext, url = F.lower(path(c)), extension(c), _url(c)
    pair = lambda a, b: F.struct(F.lit(a).alias("category"), (b if isinstance(b, Column) else F.lit(b).cast("string")).alias("subcategory"))
    mp3 = F.when((ext == ".mp3") | low.contains("mp3"), "mp3").otherwise("other_audio")
    seen = lambda shapes: url.rlike("(?i)" + "|".join(shapes))
    social = _social_class(c)
    return (
        F.when(~is_valid(c), pair("invalid", None))
        .when(ext.isin(AUDIO) | low.contains("mp3") | low.contains("audio"), pair("audio", mp3))
        .when(ext.isin(IMAGES) | _any_in(low, IMAGE_FOLDERS), pair("images", F.when(ext != "", F.substring(ext, 2, 99)).otherwise("other_image")))
        .when(ext.isin(DOCUMENTS), pair("html", "documents"))
        .when(social.isNotNull(), pair("social", social))
        .when(seen(GOVERNMENT), pair("html", "government"))
        .when(seen(EDUCATION), pair("html", "educational"))
        .when(seen(NEWS), pair("html", "news"))
        .otherwise(pair("html", "other_html"))
    )


def classify_one_level(c: Column) -> Column:
    """The first class one of whose substrings occurs."""
    low, found = F.lower(_url(c)), F.when(_url(c) == "", "invalid")
    for kind, parts in ONE_LEVEL.items():
        found = found.when(_any_in(low, parts), kind)
    return found.otherwise("other")


def classify_bucket(c: Column) -> Column:
    """images, social, html or other; null for what is no URL."""
    return F.when(~is_valid(c), None).when(is_image(c), "images").when(is_social(c), "social").when(scheme(c).isin("http", "https"), "html").otherwise("other")


def classify_content(c: Column) -> Column:
    """The seven classes that extraction is dispatched by."""
    low = F.lower(_url(c))
    return (
        F.when(is_facebook(c), "facebook")
        .when(_any_in(low, ["youtube.com", "youtu.be"]), "youtube")
        .when(_any_in(low, ["rpp.pe", "larepublica.pe", "elperuano", "diariocorreo", "andina.pe", "infobae.com"]), "news")
        .when(_any_in(low, [".jpg", ".jpeg", ".png", ".gif"]), "image")
        .when(low.endswith(".pdf") | low.contains("dispositivo"), "document")
        .when(_any_in(low, [".mp3", ".mp4", ".avi", ".mov"]), "media")
        .otherwise("other")
    )


def infer_type(c: Column) -> Column:
    """A guess at the content's type by substrings of host and path; null for none."""
    d, p = F.lower(netloc(c)), F.lower(path(c))
    return (
        F.when(_any_in(d, ["facebook.com", "fb.com"]), "facebook")
        .when(_any_in(d, ["youtube.com", "youtu.be"]), "youtube")
        .when(_any_in(d, ["twitter.com", "x.com", "t.co"]), "twitter")
        .when(_any_in(p, [".jpg", ".jpeg", ".png", ".gif"]), "image")
        .when(_any_in(p, [".mp3", ".wav", ".ogg"]), "audio")
        .when(_any_in(p, [".mp4", ".avi", ".mov"]), "video")
        .when(p.contains(".pdf"), "document")
        .when(_any_in(d, ["noticia", "news", "diario", "periodico", "times", "post"]), "news")
    )


def legacy_bucket(category: Column) -> Column:
    """The category tree in the older four buckets."""
    return F.when(category.isin("html", "images", "social"), category).otherwise("other")


def threshold(category: Column, subcategory: Column) -> Column:
    """The similarity threshold of a class."""
    found = None
    for (a, b), t in THRESHOLDS.items():
        hit = (category == a) & (subcategory == b) if b else category == a
        found = F.when(hit, F.lit(t)) if found is None else found.when(hit, F.lit(t))
    return found.otherwise(F.lit(DEFAULT_THRESHOLD))


def cache_key(c: Column) -> Column:
    return F.md5(_url(c))


def short_key(c: Column) -> Column:
    return F.substring(F.sha2(_url(c), 256), 1, 16)
