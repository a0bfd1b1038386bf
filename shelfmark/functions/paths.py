"""Column functions over paths and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folder words that say nothing, month words, extensions, device names. Results depend on them.
GENERIC_SEGMENTS = (
    "pictures", "picture", "pics", "pic", "photos", "photo", "images", "image", "img", "media", "camera", "camera roll",
    "camera uploads", "dcim", "google photos", "my pictures", "my photos", "saved pictures", "downloads", "download", "desktop",
    "temp", "tmp", "misc", "untitled",
    "фото", "фотки", "фотографии", "картинки", "изображения", "снимки", "медиа", "камера", "загрузки", "рабочий стол", "разное",
    "без названия",
)
MONTH_WORDS = (
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
    "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec",
    "январь", "января", "февраль", "февраля", "март", "марта", "апрель", "апреля", "май", "мая", "июнь", "июня", "июль", "июля",
    "август", "августа", "сентябрь", "сентября", "октябрь", "октября", "ноябрь", "ноября", "декабрь", "декабря",
    "янв", "фев", "мар", "апр", "июн", "июл", "авг", "сен", "окт", "ноя", "дек",
)
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".tif", ".webp", ".heic", ".heif", ".raw", ".cr2", ".nef", ".arw", ".dng")
VIDEO_EXTENSIONS = (".mp4", ".mov", ".avi", ".mkv", ".wmv", ".flv", ".webm", ".m4v", ".3gp", ".mts", ".m2ts")
ARCHIVE_SUFFIXES = {
    ".tar.bz2": "tar", ".tar.gz": "tar", ".tar.xz": "tar", ".tbz2": "tar", ".tgz": "tar", ".zip": "zip", ".tar": "tar", ".rar": "rar", ".7z": "7z",
}
RESERVED_NAMES = ("con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10)))
TRANSLITERATION = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l",
    "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh",
    "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
SEASONS = ("Winter", "Spring", "Summer", "Autumn")

GENERIC, DATED, NAMED = 0, 1, 2


def forward(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def basename_of(path: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(forward(path), "/+$", ""), "[^/]*$", 0)


def stem_of(path: Column) -> Column:
    return F.regexp_replace(basename_of(path), r"(?<=.)\.[^.]+$", "")


def folder_of(path: Column) -> Column:
    """The path without its last part, with the separators that it has; empty without a separator."""
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def extension_of(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^./\\]+)$", 1))


def media_kind(name: Column) -> Column:
    ext = extension_of(name)
    return F.when(ext.isin(*IMAGE_EXTENSIONS), "image").when(ext.isin(*VIDEO_EXTENSIONS), "video").otherwise("other")


def archive_kind(path: Column) -> Column:
    """By the longest suffix; null for what is no archive."""
    low, out = F.lower(basename_of(path)), None
    for suffix, kind in sorted(ARCHIVE_SUFFIXES.items(), key=lambda x: -len(x[0])):
        hit = low.endswith(suffix)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def path_segments(path: Column, drive: str = "^[A-Za-z]:$") -> Column:
    """Folder names above a file, without the drive."""
    parts = F.filter(F.split(forward(path), "/"), lambda p: p != "")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.filter(folders, lambda p: ~p.rlike(drive))


def segment_kind(name: Column) -> Column:
    """0 generic, 1 dated, 2 named."""
    low = F.lower(F.trim(name))
    rest = low
    for word in sorted(MONTH_WORDS, key=len, reverse=True):
        rest = F.replace(rest, F.lit(word), F.lit(" "))
    rest = F.regexp_replace(rest, r"(?U)\d+", "")
    rest = F.regexp_replace(rest, r"(?U)[\s\-_.,;/\\~–—]+", "")
    generic = (low == "") | low.isin(*GENERIC_SEGMENTS) | low.rlike(r"^(new folder|новая папка)\s*(\(\d+\))?$")
    return F.when(generic, GENERIC).when(low.rlike(r"(?U)\d") & (rest == ""), DATED).otherwise(NAMED)


def deepest_named(segments: Column) -> Column:
    """The last segment of the named kind, or null."""
    return F.get(F.filter(F.reverse(segments), lambda s: segment_kind(s) == NAMED), F.lit(0))


def volume_of(path: Column) -> Column:
    """A share, a drive letter, or the root."""
    text = F.trim(path)
    share = r"^[\\/]{2}([^\\/]+)[\\/]+([^\\/]+)"
    return (
        F.when(text.rlike(share), F.concat(F.lit("\\\\"), F.regexp_extract(text, share, 1), F.lit("\\"), F.regexp_extract(text, share, 2)))
        .when(text.rlike("^[A-Za-z]:"), F.concat(F.upper(F.substring(text, 1, 1)), F.lit(":")))
        .otherwise("/")
    )


def sanitize_component(name: Column, max_chars: int = 120) -> Column:
    """One part of a path that a file system accepts."""
    c = F.trim(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "-"))
    c = F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"[ .]+$", "")
    reserved = F.lower(c).isin(*RESERVED_NAMES) | F.lower(F.substring_index(c, ".", 1)).isin(*RESERVED_NAMES)
    named = F.when(reserved, F.concat(F.lit("_"), c)).otherwise(c)
    cut = F.when(F.length(named) > max_chars, F.regexp_replace(F.substring(named, 1, max_chars), r"[ .]+$", "")).otherwise(named)
    return F.when(cut == "", "_").otherwise(cut)


def latinise(text: Column) -> Column:
    """Cyrillic letters in Latin ones; a capital stays a capital."""
    table = F.create_map(*[F.lit(x) for kv in TRANSLITERATION.items() for x in kv])

    def one(c: Column) -> Column:
        to = F.try_element_at(table, F.lower(c))
        return F.when(to.isNull(), c).when((c != F.lower(c)) & (to != ""), F.concat(F.upper(F.substring(to, 1, 1)), F.substring(to, 2, 9))).otherwise(to)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def place_label(subject: Column) -> Column:
    """Without outskirts and bare years."""
    t = F.regexp_replace(subject, r"(?iu)\s*\((?:окрестности|окрест\.?)\)\s*", " ")
    t = F.regexp_replace(t, r"(?U)\b(?:19|20)\d{2}\b", " ")
    return F.regexp_replace(F.regexp_replace(t, r"\s{2,}", " "), "^[ \\-—,]+|[ \\-—,]+$", "")


def season_of(month: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEASONS)), F.floor((month % 12) / 3).cast("int") + 1)


def join_path(root: Column, *parts: Column) -> Column:
    """Parts under a root, with the root's separator."""
    sep = F.when(root.contains("\\") | root.rlike("^[A-Za-z]:"), "\\").otherwise("/")
    tail = [F.regexp_replace(p, r"^[/\\]+|[/\\]+$", "") for p in parts]
    kept = F.filter(F.array(F.regexp_replace(root, r"[/\\]+$", ""), *tail), lambda p: p != "")
    return F.concat_ws("", F.transform(kept, lambda p, i: F.when(i == 0, p).otherwise(F.concat(sep, p))))
