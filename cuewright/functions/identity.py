"""Identity of sources and of content."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Hosts of the video site in the test data and in public use, and suffixes of media files.
VIDEO_HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com", "clips.example", "www.clips.example", "m.clips.example")
SHORT_HOSTS = ("youtu.be", "clp.example")
MEDIA_SUFFIXES = (".aac", ".flac", ".m4a", ".mkv", ".mov", ".mp3", ".mp4", ".mpeg", ".mpg", ".oga", ".ogg", ".opus", ".wav", ".webm")

VIDEO_ID = r"^[A-Za-z0-9_-]{11}\z"


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def video_id(url: Column) -> Column:
    """The 11-character id of a video's web address in any of its forms, or null: short host, ``/watch?v=``, ``/shorts/``, ``/embed/``."""
    host, path = url_host(url), url_path(url)
    by_query = F.regexp_extract(F.trim(url), r"^[^#]*[?&]v=([^&#]*)", 1)
    first, second = F.regexp_extract(path, r"^/+([^/]+)", 1), F.regexp_extract(path, r"^/+(?:shorts|embed)/([^/]+)/*\z", 1)
    found = F.when(host.isin(*SHORT_HOSTS), first).when(host.isin(*VIDEO_HOSTS) & (path == "/watch"), by_query).when(host.isin(*VIDEO_HOSTS), second)
    return F.when(F.trim(url).rlike("^(?i:https?)://") & found.rlike(VIDEO_ID), found)


def canonical_url(vid: Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), vid)


def looks_like_media(value: Column) -> Column:
    """Whether a value names a local media file: no web address, and one of the known suffixes."""
    suffix = F.lower(F.regexp_extract(value, r"[^/\\](\.[^./\\]+)\z", 1))
    return ~value.rlike("^(?i:https?):") & suffix.isin(*MEDIA_SUFFIXES)


def source_identity(value: Column, digest: Column) -> Column:
    """What an address or a path stands for: ``struct<kind, source_id, canonical_url>``, all null where it is neither a video's address nor a media file.

    ``digest`` is that of the file's bytes.
    """
    vid = video_id(value)
    media = looks_like_media(value)
    kind = F.when(vid.isNotNull(), "youtube").when(media, "local_media")
    name = F.when(vid.isNotNull(), F.concat(F.lit("youtube:"), vid)).when(media, F.concat(F.lit("local:"), digest))
    return F.struct(kind.alias("kind"), name.alias("source_id"), canonical_url(vid).alias("canonical_url"))


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with keys in alphabetical order and nulls kept. Control characters below a blank are dropped from text beforehand by callers."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def fingerprint(**fields: Column) -> Column:
    """SHA-256 of the canonical JSON."""
    return F.sha2(canonical_json(**fields), 256)


def artifact_path(digest: Column) -> Column:
    return F.concat(F.substring(digest, 1, 2), F.lit("/"), F.substring(digest, 3, 64), F.lit(".json.zst"))
