"""URLs, pages and embedded JSON as columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VIDEO_SUFFIXES = ["mp4", "m4v", "mkv", "webm", "mov", "avi", "wmv", "flv", "ts"]
IMAGE_SUFFIXES = ["jpg", "jpeg", "png", "gif", "webp", "bmp", "avif"]
URL = r"""https?://[^\s,;"'<>]+"""


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def basename(url: Column) -> Column:
    return F.regexp_extract(path(url), "([^/]*)$", 1)


def extension(url: Column) -> Column:
    """Lower case, without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(basename(url), r"\.([^.]*)$", 1))


def sanitize_url(url: Column) -> Column:
    """Trimmed, https where there is no scheme, without query and fragment."""
    u = F.trim(url)
    u = F.when(u.rlike("(?i)^[a-z][a-z0-9+.-]*://"), u).otherwise(F.concat(F.lit("https://"), u))
    return F.regexp_replace(u, "[?#].*$", "")


def urls_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(URL), F.lit(0))


def routed(url: Column, rules: list[tuple[str, str]], default: str = "unsupported") -> Column:
    """The class of the first rule whose domain the host contains."""
    out = None
    for domain, name in rules:
        hit = F.contains(host(url), F.lit(domain))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default) if out is not None else F.lit(default)


def supported_line(line: Column, domains: list[str]) -> Column:
    hit = F.lit(False)
    for d in domains:
        hit = hit | F.contains(F.lower(line), F.lit(d))
    return hit & line.rlike("(?i)https?://")


def page_title(html: Column) -> Column:
    """The title before the first bar, percent-decoded."""
    title = F.nullif(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit(""))
    return F.trim(percent_decode(F.element_at(F.split(title, r"\|"), 1)))


def percent_decode(text: Column) -> Column:
    """A plus stays a plus; what can't be decoded stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def hrefs(html: Column) -> Column:
    """All targets of anchors in page order."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1))


def next_page(url: Column) -> Column:
    """page=n becomes page=n+1; where there is none, page=2 is added."""
    n = F.regexp_extract(url, r"[?&]page=(\d+)", 1)
    bumped = F.regexp_replace(url, F.lit(r"([?&]page=)\d+"), F.concat(F.lit("$1"), (n.try_cast("int") + 1).cast("string")))
    return F.when(n != "", bumped).otherwise(F.concat(url, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), F.lit("page=2")))


def last_page(link_texts: Column, current: Column) -> Column:
    numbers = F.filter(F.transform(link_texts, lambda t: F.trim(t).try_cast("int")), lambda n: n.isNotNull())
    return F.coalesce(F.array_max(numbers), current)


def segment_after(url: Column, marker: str = "d") -> Column:
    """The path segment after the marker; null if there is none."""
    return F.nullif(F.regexp_extract(path(url), f"/{marker}/([^/]+)", 1), F.lit(""))


def embedded_json(html: Column, element_id: str) -> Column:
    return F.nullif(F.regexp_extract(html, rf"""(?is)<script[^>]*\bid=["']{element_id}["'][^>]*>(.*?)</script>""", 1), F.lit(""))


def assigned_json(html: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(html, rf"(?s){name}\s*=\s*(\{{.*?\}})\s*;", 1), F.lit(""))


def json_or(json: Column, default: str, *paths: str) -> Column:
    """The first path that holds something, else the default."""
    return F.coalesce(*(F.nullif(F.get_json_object(json, p), F.lit("")) for p in paths), F.lit(default))


def within_dates(text: Column, low: Column, high: Column, pattern: str = "HH:mm:ss dd/MM/yyyy") -> Column:
    """Inclusive and open where a bound is null; kept if it can't be read."""
    t = F.try_to_timestamp(text, F.lit(pattern))
    return F.coalesce((t >= F.coalesce(low, t)) & (t <= F.coalesce(high, t)), F.lit(True))


def allowed_extension(ext: Column, allowed: list[str], empty_ok: bool = False) -> Column:
    if not allowed:
        return F.lit(True)
    return ext.isin(allowed) | (F.lit(empty_ok) & (ext == ""))


def suspicious_small(url: Column, size: Column, resumed: Column, only_video: bool) -> Column:
    """Under 1 MiB, or a page that says maintenance or deleted."""
    small = size < 1 << 20
    kind = extension(url).isin(VIDEO_SUFFIXES) & ~resumed if only_video else F.lit(True)
    return (small & kind) | F.lower(url).rlike("maintenance|deleted")


def valid_response(status: Column, part: Column) -> Column:
    return F.when(status.isin(403, 404, 405, 500), False).when(part == 0, status.isin(200, 206)).otherwise(status == 206)


def media_kind(ext: Column) -> Column:
    return F.when(ext.isin(IMAGE_SUFFIXES), "image").when(ext.isin(VIDEO_SUFFIXES), "video").otherwise("other")


def download_name(name: Column, url: Column) -> Column:
    """A clean name with the URL's extension if it lacks it; the URL's own name if there is none."""
    from brindle.functions.names import clean_name

    clean, ext = clean_name(name), extension(url)
    full = F.when((ext == "") | F.endswith(F.lower(clean), F.concat(F.lit("."), ext)), clean).otherwise(F.concat(clean, F.lit("."), ext))
    return F.when(F.coalesce(clean, F.lit("")) == "", basename(url)).otherwise(full)


def severity(line: Column) -> Column:
    up = F.upper(line)
    return F.when(F.contains(up, F.lit("ERROR")), "ERROR").when(F.contains(up, F.lit("WARN")), "WARN").when(F.contains(up, F.lit("DONE")), "DONE").otherwise("INFO")


def error_summary(log: Column, banner: str = "^(ffmpeg version|  built with|  configuration:|  lib)", tail: int = 2000) -> Column:
    kept = F.filter(F.split(log, "\n"), lambda x: ~x.rlike(banner) & (F.trim(x) != ""))
    return F.right(F.array_join(kept, "\n"), F.lit(tail))


def unpacked_script():
    """A UDF: the script that a p,a,c,k,e,d packer hides; null if it isn't one."""
    shape = re.compile(r"\}\('(.*?)',\s*(\d+),\s*(\d+),\s*'(.*?)'\.split\('\|'\)", re.S)
    digits = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"

    @F.pandas_udf("string")
    def unpack(scripts: pd.Series) -> pd.Series:
        def one(script: str | None) -> str | None:
            if not script or not (m := shape.search(script)):
                return None
            base, words = int(m[2]), m[4].split("|")

            def value(word: str) -> str:
                n = 0
                for c in word:
                    if (d := digits.find(c)) < 0 or d >= base:
                        return word
                    n = n * base + d
                return words[n] if n < len(words) and words[n] else word

            return re.sub(r"\b\w+\b", lambda w: value(w[0]), m[1])

        return scripts.map(one)

    return unpack


def anchors(html: Column) -> Column:
    """array of struct(url, name) of the page's links, each URL once: the link's text, else its image's alternative text."""
    shape = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""
    urls, inner = (F.regexp_extract_all(html, F.lit(shape), F.lit(k)) for k in (1, 2))
    text = lambda x: F.nullif(F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"\s+", " ")), F.lit(""))
    alt = lambda x: F.nullif(F.regexp_extract(x, r"""(?is)<img\s[^>]*?alt\s*=\s*["']([^"']*)["']""", 1), F.lit(""))
    every = F.zip_with(urls, inner, lambda u, x: F.struct(u.alias("url"), F.coalesce(text(x), alt(x)).alias("name")))
    return F.filter(every, lambda x, i: F.array_position(urls, x["url"]) == i + 1)


def media_source(html: Column) -> Column:
    """The address that a player's source list begins with; null if there is none."""
    return F.nullif(F.regexp_extract(html, r'sourcesCode:\s*\[\{\s*src:\s*"([^"]+)",\s*type:', 1), F.lit(""))


def signed_video(html: Column) -> Column:
    """The path of a signed video request in a script; null if there is none."""
    parts = [F.regexp_extract(html, r"get_video\?id=([^&']+)&expires=([^&']+)&ip=([^&']+)&token=([^&']+)", k) for k in range(1, 5)]
    return F.when(parts[0] != "", F.concat(F.lit("/get_video?id="), parts[0], F.lit("&expires="), parts[1], F.lit("&ip="), parts[2], F.lit("&token="), parts[3]))


def first_and_more(items: Column, n: int = 10) -> Column:
    """The first items a line each, and how many more there are."""
    head = F.array_join(F.slice(items, F.lit(1), F.lit(n)), "\n")
    return F.when(F.size(items) > n, F.concat(head, F.lit("\n… and "), (F.size(items) - n).cast("string"), F.lit(" more"))).otherwise(head)


def progress_seconds(line: Column) -> Column:
    """Seconds of a time=H:M:S mark; null if there is none."""
    h, m, s = (F.regexp_extract(line, r"time=(\d+):(\d+):(\d+(?:\.\d+)?)", k).try_cast("double") for k in (1, 2, 3))
    return h * 3600 + m * 60 + s
