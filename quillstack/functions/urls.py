"""URL, file name and route functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstack.schema import PAYWALLED

# Addresses of repositories and of their files.
REPO = r"https?://(?:www\.)?github\.com/([^/]+)/([^/?#]+)/?(?:[?#].*)?$"
BLOB = r"https?://(?:www\.)?github\.com/([^/]+)/([^/]+)/blob/([^/]+)/(.+)"

#: The authority after a scheme; schemes of the web take any slashes before it.
WEB = r"^(?i:https?|wss?|ftp):[/\\]*([^/\\?#]*)"
OTHER = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"


def article_id(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 12)


def sanitize(text: Column, longest: int) -> Column:
    """A name for a file: forbidden characters out, white space as underscores, at most `longest` code points."""
    bare = F.regexp_replace(text, r'[<>:"/\\|?*]', "")
    trimmed = F.regexp_replace(bare, r"(?U)^\s+|\s+$", "")
    cut = F.substring(F.regexp_replace(trimmed, r"(?U)\s+", "_"), 1, longest)
    return F.when(cut == "", "untitled").otherwise(cut)


def filename(url: Column, title: Column) -> Column:
    return F.concat(article_id(url), F.lit("_"), sanitize(title, 80), F.lit(".txt"))


def host(url: Column) -> Column:
    """Lower-case host without one leading www.; null for what is not a URL.

    The authority is what stands before the path, whatever comes after; a host with a character that no
    host has, or a port that is none, makes it no URL. International names stay as they are written.
    """
    bare = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"[\t\n\r]", "")
    place = F.regexp_replace(F.when(bare.rlike(WEB), F.regexp_extract(bare, WEB, 1)).otherwise(F.regexp_extract(bare, OTHER, 1)), r"^.*@", "")
    name = F.lower(F.regexp_extract(place, r"^(\[[0-9A-Fa-f:.]+\]|[^\x00-\x20:<>\[\]^|%]+)(?::([0-9]*))?$", 1))
    port = F.coalesce(F.regexp_extract(place, r":([0-9]+)$", 1).try_cast("int"), F.lit(0))
    return F.when((name != "") & (port < 65536), F.regexp_replace(name, r"^www\.", ""))


def netloc(url: Column) -> Column:
    """User, host and port as they are written; empty without them."""
    bare = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+", ""), r"[\t\n\r]", "")
    return F.coalesce(F.regexp_extract(bare, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1), F.lit(""))


def paywalled_domain(url: Column) -> Column:
    return F.when(host(url).isin(PAYWALLED), host(url))


def is_paywalled(url: Column) -> Column:
    return F.coalesce(host(url).isin(PAYWALLED), F.lit(False))


def is_video(url: Column) -> Column:
    return url.contains("youtube.com") | url.contains("youtu.be")


def is_code_host(url: Column) -> Column:
    return url.contains("github.com") & ~url.contains("gist.")


def is_hostile(url: Column) -> Column:
    return url.contains("medium.com") | url.contains("towardsdatascience.com")


def route(url: Column, last_attempt: bool) -> Column:
    """The sources tried for a URL, in order."""
    steps = [
        F.when(is_video(url), F.lit("video")), F.when(is_code_host(url), F.lit("code")), F.when(is_hostile(url), F.lit("archive")),
        F.when(is_paywalled(url), F.lit("reader")), F.lit("page"), F.lit("archive") if last_attempt else F.lit(None).cast("string"),
    ]
    return F.filter(F.array(*steps), lambda x: x.isNotNull())


def blob_source(url: Column) -> Column:
    """Raw address and title of a file on the code host; null for other URLs."""
    part = lambda i: F.regexp_extract(url, BLOB, i)
    path = F.regexp_replace(part(4), r"[?#].*$", "")
    return F.when(url.rlike(BLOB), F.struct(
        F.concat_ws("/", F.lit("https://raw.githubusercontent.com"), part(1), part(2), part(3), part(4)).alias("raw_url"),
        F.concat(part(1), F.lit("/"), part(2), F.lit(": "), F.element_at(F.split(path, "/"), -1)).alias("title"),
    ))


def readme_source(url: Column, body: Column) -> Column:
    """Title and text of a repository's README from the API's JSON; null for other URLs or bodies."""
    content = F.decode(F.try_to_binary(F.replace(F.get_json_object(body, "$.content"), F.lit("\n"), F.lit("")), F.lit("base64")), "UTF-8")
    found = F.struct(F.concat(F.regexp_extract(url, REPO, 1), F.lit("/"), F.regexp_extract(url, REPO, 2)).alias("title"), content.alias("text"))
    return F.when(url.rlike(REPO) & content.isNotNull(), found)


def snapshot(final_url: Column, status: Column, availability: Column) -> Column:
    """The archived copy: the first archive's answer if it is one, else the second's closest snapshot."""
    first = F.when((status >= 200) & (status < 300) & final_url.contains("archive.ph"), F.struct(F.lit("Archive.ph").alias("archive"), final_url.alias("url")))
    closest = F.from_json(availability, "archived_snapshots struct<closest: struct<available: boolean, url: string>>")["archived_snapshots"]["closest"]
    second = F.when(closest["available"], F.struct(F.lit("Internet Archive Wayback Machine").alias("archive"), closest["url"].alias("url")))
    return F.coalesce(first, second)


def with_provenance(text: Column, archive: Column, url: Column, snapshot_url: Column) -> Column:
    # Fixed value: the note below archived texts.
    return F.concat(text, F.lit("\n\n---\nNote: This article was retrieved from "), archive, F.lit("\nOriginal URL: "), url, F.lit("\nArchive URL: "), snapshot_url, F.lit("\n"))
