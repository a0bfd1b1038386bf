"""Where a picture came from: ordered rules over camera data, names, folders and sizes; the first match wins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.paths import basename_of, forward, stem_of

# Words, name patterns and screens that the rules look for.
SCANNER_WORDS = (
    "canoscan", "scanjet", "perfection", "lide", "epson scan", "mustek", "plustek", "scansnap", "workforce ds", "brother mfc",
    "brother dcp", "adobe scan", "camscanner", "office lens", "microsoft lens", "genius scan", "tiny scanner", "scanbot", "photoscan",
    "notebloc",
)
MESSENGER_FOLDERS = (
    "whatsapp", "whatsapp images", "telegram", "telegram images", "telegram desktop", "viber", "viber images", "signal", "messenger",
    "imo", "wechat", "weixin", "facebook messenger", "kato",
)
SCREENSHOT_FOLDERS = ("screenshot", "screenshots", "screen shots", "снимки экрана", "скриншоты", "снимок экрана", "captures", "screen captures")
DOCUMENT_FOLDERS = ("документы", "documents", "docs", "scans", "сканы", "справки", "паспорт", "docs scans")
DOWNLOAD_FOLDERS = ("downloads", "загрузки", "download", "saved pictures")
MESSENGER_NAMES = (
    r"^IMG-\d{8}-WA\d+",
    r"^whatsapp (image|video|audio|animated)",
    r"^photo_\d+@\d{2}-\d{2}-\d{4}",
    r"^viber[_ ]image",
    r"^received_\d{10,}",
    r"^FB_IMG_\d+",
)
SCREENSHOT_ANDROID = r"^screenshot[_-]?\d{8}[-_]\d{6}"
SCREENSHOT_WINDOWS = r"^(снимок экрана|screenshot)\s*[\(\d]"
SCREENSHOT_MACOS = r"^(screen shot|снимок экрана \d{4}-\d{2}-\d{2} в)"
SCREENSHOT_GENERIC = r"^(screenshot|screen[ _-]?shot|скриншот|снимок[ _]экрана|zrzut ekranu|bildschirmfoto|captura de pantalla|capture d)"
VIDEO_CAPTURE = r"^videocapture[_-]?\d{8}"
DOCUMENT_NAME = r"^(new doc|scan[_\- ]?\d|scanned|скан[_\- ]|документ[_\- ]|doc[_\- ]?\d{4})"
WEB_NAME = r"^(download|unnamed|untitled|image[s]?[ _(]|изображение|img[ _]\(\d+\)|[0-9a-f]{24,}$|\d{5,}_\d{10,}(_\d+){2,}_[on]$)"
CAMERA_NAME = (
    r"^(\d{8}[_-]\d{6}|img[_-]\d{8}[_-]\d{6}|img[_-]\d{3,5}|_mg_\d{3,5}|dsc[_n]?\d{3,5}|_dsc\d{3,5}|p\d{7,8}|imag\d{3,5}|sdc\d{4,6}|\d{3}[_-]\d{4}|\d{3}o\d{4}a\d{3,5})"
)
EDITED = r"(-edited|-COLLAGE|-EFFECTS|-ANIMATION|-PHOTO_FRAME|_remastered|^Picsart_|^SLazerprint|-min$|~\d+$)"
PHONE_SCREENS = (
    (720, 1280), (750, 1334), (828, 1792), (1080, 1920), (1080, 2160), (1080, 2220), (1080, 2244), (1080, 2280), (1080, 2310), (1080, 2340),
    (1080, 2400), (1080, 2408), (1080, 2412), (1080, 2436), (1125, 2436), (1170, 2532), (1179, 2556), (1206, 2622), (1242, 2688), (1284, 2778),
    (1290, 2796), (1320, 2868), (1440, 2560), (1440, 2880), (1440, 2960), (1440, 3040), (1440, 3088), (1440, 3120), (1440, 3200), (640, 1136),
    (768, 1024), (1536, 2048), (1620, 2160), (1668, 2388), (2048, 2732),
)
DESKTOP_SCREENS = (
    (1280, 720), (1280, 800), (1280, 1024), (1360, 768), (1366, 768), (1440, 900), (1536, 864), (1600, 900), (1680, 1050), (1920, 1080),
    (1920, 1200), (2048, 1152), (2560, 1080), (2560, 1440), (2560, 1600), (2880, 1800), (3440, 1440), (3840, 2160), (1512, 982), (1728, 1117),
    (2736, 1824), (1470, 956), (1512, 945),
)
PHOTO_RATIOS, PHOTO_TOLERANCE = (1.0, 1.25, 1.3333, 1.5, 1.6, 1.7778), 0.02
PAPER_RATIOS, PAPER_TOLERANCE = (1.4142, 1.2941), 0.02
EXCLUDED_FROM_ALBUMS = ("screenshot_phone", "screenshot_desktop", "document_scan")


def _like(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(f"(?iu){pattern}"), F.lit(False))


def _any_word(c: Column, words: tuple[str, ...]) -> Column:
    """One pass for all words: an alternation of the quoted words."""
    return F.lower(F.coalesce(c, F.lit(""))).rlike("|".join(re.escape(w) for w in words))


def _size_in(w: Column, h: Column, sizes: tuple) -> Column:
    return F.coalesce((w * 100_000 + h).isin(*[a * 100_000 + b for a, b in sizes]), F.lit(False))


def classify_origin(rows: DataFrame) -> DataFrame:
    """Adds origin_class, origin_confidence and origin_evidence (array).

    Needs display_path; uses width, height, exif_make, exif_model, exif_software, has_gps, image_format, sidecar_key
    (Google's origin) and sidecar_geo where a table has them; nulls are facts not known.
    """
    col = lambda name, kind="string": F.col(name) if name in rows.columns else F.lit(None).cast(kind)
    # The parts of the path are columns first, so that the many rules below don't work them out again.
    path = F.col("__path")
    rows = rows.withColumn("__path", forward(F.col("display_path")))
    rows = rows.withColumns({"__name": basename_of(path), "__stem": stem_of(path), "__folders": F.when(path.contains("/"), F.lower(F.regexp_replace(path, "/[^/]*$", "")))})
    name, stem = F.col("__name"), F.col("__stem")
    in_folder = lambda words: _any_word(F.col("__folders"), words)
    w, h = col("width", "int").cast("long"), col("height", "int").cast("long")
    known = F.coalesce((w > 0) & (h > 0), F.lit(False))
    ratio = F.greatest(w, h) / F.least(w, h)
    close = lambda targets, tol: F.coalesce(F.greatest(*[(F.abs(ratio - t) <= tol).cast("int") for t in targets]) == 1, F.lit(False))
    photo_shaped, paper = ~known | close(PHOTO_RATIOS, PHOTO_TOLERANCE), known & close(PAPER_RATIOS, PAPER_TOLERANCE)
    device = F.concat_ws(" ", col("exif_make"), col("exif_model"))
    has_camera = device != ""
    gps = F.coalesce(col("has_gps", "boolean"), F.lit(False)) | F.coalesce(col("sidecar_geo", "boolean"), F.lit(False))
    desktop, phone = _size_in(w, h, DESKTOP_SCREENS), _size_in(w, h, PHONE_SCREENS) | _size_in(h, w, PHONE_SCREENS)
    scroll = known & (h > w) & w.isin(*sorted({a for a, _ in PHONE_SCREENS})) & (h / w >= 2.5)
    subtype = (
        F.when(_like(name, SCREENSHOT_ANDROID) | _like(name, VIDEO_CAPTURE), "screenshot_phone")
        .when(_like(name, SCREENSHOT_WINDOWS) | _like(name, SCREENSHOT_MACOS) | desktop, "screenshot_desktop")
        .when(phone | F.coalesce((h > w) & (w > 0) & (h / w >= 1.6), F.lit(False)), "screenshot_phone")
        .otherwise("screenshot_desktop")
    )
    scanner = _any_word(device, SCANNER_WORDS) | _any_word(col("exif_software"), SCANNER_WORDS)
    messenger_name = _like(name, "(?:" + "|".join(MESSENGER_NAMES) + ")")
    capture = _like(name, SCREENSHOT_GENERIC) | _like(name, VIDEO_CAPTURE)
    document_name, web_name, camera_name = _like(name, DOCUMENT_NAME), _like(stem, WEB_NAME), _like(name, CAMERA_NAME)
    key = F.coalesce(col("sidecar_key"), F.lit(""))
    v = lambda cls, conf, why: F.struct((F.lit(cls) if isinstance(cls, str) else cls).alias("c"), (F.lit(conf) if isinstance(conf, str) else conf).alias("k"), F.lit(why).alias("w"))
    verdict = (
        F.when(scanner, v("document_scan", "high", "scanner in the camera data"))
        .when(messenger_name | in_folder(MESSENGER_FOLDERS), v("messenger", "high", "messenger name or folder"))
        .when(capture, v(subtype, "high", "name of a screen capture"))
        .when(in_folder(SCREENSHOT_FOLDERS), v(subtype, "medium", "folder of screen captures"))
        .when(has_camera, v("camera", "high", "camera data"))
        .when(document_name | in_folder(DOCUMENT_FOLDERS), v("document_scan", F.when(document_name & paper, "high").otherwise("medium"), "document name or folder"))
        .when(key == "webUpload", v("web_download", "medium", "uploaded from the web"))
        .when(in_folder(DOWNLOAD_FOLDERS) | web_name, v("web_download", "medium", "download folder or browser name"))
        .when((desktop | phone) & ~photo_shaped, v(subtype, "medium", "size of a screen that no photo has"))
        .when(camera_name & scroll, v("screenshot_phone", "low", "scrolled capture"))
        .when(camera_name, v("camera", F.when(key == "mobileUpload", "high").otherwise("medium"), "name in a camera's style"))
        .when(gps, v("camera", "medium", "position without camera data"))
        .when(F.upper(F.coalesce(col("image_format"), F.lit(""))) == "WEBP", v("web_download", "low", "web format"))
        .otherwise(v("unknown", "low", "no rule applies"))
    )
    facts = F.array_compact(
        F.array(
            F.when(has_camera, F.concat(F.lit("camera: "), device)),
            F.when(col("exif_software").isNotNull(), F.concat(F.lit("software: "), col("exif_software"))),
            F.when(gps, "position"),
            F.when(_like(stem, EDITED), "edited"),
            F.when(key != "", F.concat(F.lit("sidecar: "), key)),
        )
    )
    return (
        rows.withColumn("__v", verdict)
        .withColumns({"origin_class": F.col("__v.c"), "origin_confidence": F.col("__v.k"), "origin_evidence": F.array_append(facts, F.col("__v.w"))})
        .drop("__v", "__path", "__name", "__stem", "__folders")
    )


def origin_breakdown(rows: DataFrame) -> DataFrame:
    """origin_class, origin_confidence, n, and its share of all rows."""
    counts = rows.groupBy("origin_class", "origin_confidence").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("__total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("__total")).drop("__total")  # a handful of classes
