"""Label, protocol, address and condition rules as native columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vocabularies and rules that results depend on, in their order of precedence.
SERVICES = ("streaming", "gaming", "conferencing", "bulk_transfer", "browsing", "xr_interactive", "iot_security", "unknown")
CONDITIONS = ("good", "moderate", "degraded", "bad", "unknown")
APPS_OF_SERVICE = {
    "streaming": (
        "youtube", "youtube_live", "netflix", "prime_video", "primevideo", "amazon_prime", "twitch", "naver_now", "afreecatv", "crave", "video_streaming", "streaming",
    ),
    "gaming": (
        "valorant", "val", "league_of_legends", "lol", "teamfight_tactics", "tft", "roblox", "minecraft", "battleground", "geforce_now", "kt_gamebox", "fortnite",
        "forza_horizon_5", "mortal_kombat_11", "cloud_gaming", "gaming",
    ),
    "conferencing": ("zoom", "teams", "google_meet", "discord", "voip", "conferencing"),
    "bulk_transfer": ("download", "file_download", "ftp", "bulk", "bulk_transfer"),
    "browsing": ("web", "web_browsing", "browsing"),
    "xr_interactive": ("vr", "ar", "xr", "metaverse", "zepeto", "cloud_vr", "vr_video", "xr_interactive"),
    "iot_security": ("benign", "ddos", "dos", "recon", "web_attack", "bruteforce", "brute_force", "spoofing", "mirai"),
}
ALIASES = {
    "yt": "youtube",
    "prime": "prime_video",
    "lol": "league_of_legends",
    "tft": "teamfight_tactics",
    "meet": "google_meet",
    "http_download": "file_download",
    "cloudvr": "cloud_vr",
}
SERVICE_OF_CATEGORY = {
    "streaming_media": "streaming",
    "music": "streaming",
    "games": "gaming",
    "videoconferencing": "conferencing",
    "file_sharing": "bulk_transfer",
    "search": "browsing",
    "social": "browsing",
    "blogs_news": "browsing",
    "e_commerce": "browsing",
    "mail": "browsing",
    "advertising": "browsing",
    "authentication_services": "browsing",
    "analytics_telemetry": "browsing",
    "information_systems": "browsing",
    "instant_messaging": "browsing",
    "other_services_and_apis": "browsing",
    "antivirus": "browsing",
}
PATH_TOKENS = (
    "youtube_live", "youtube", "netflix", "amazon_prime", "zoom", "ms_teams", "google_meet", "roblox", "zepeto", "battleground", "teamfight_tactics", "geforce_now",
    "kt_gamebox", "naver_now", "afreecatv",
)
UDP_NAMES, TCP_NAMES = ("udp", "quic", "dns", "rtp", "17"), ("tcp", "tls", "ssl", "http", "https", "6")
UDP, TCP = 17, 6
PRIVATE_PREFIXES = ("10.", "192.168.", "172.16.", "172.17.", "172.18.", "172.19.", "172.2", "172.30.", "172.31.")
RTT_LIMITS, JITTER_LIMITS, LOSS_LIMITS = (80.0, 180.0), (25.0,), (0.01, 0.04)

SERVICE_OF_APP = {app: service for service, apps in APPS_OF_SERVICE.items() for app in apps}


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize_label(label: Column | str) -> Column:
    """Lower case, separators to one underscore (pairs are folded once), aliases resolved; null or '' is ``unknown``."""
    c = _column(label)
    c = F.when(c.isNull() | (c == ""), "unknown").otherwise(c)
    c = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    c = F.replace(F.translate(c, "/- ", "___"), F.lit("__"), F.lit("_"))
    return let(c, lambda text: F.coalesce(_lookup(ALIASES, text), text))


def infer_service(label: Column | str) -> Column:
    """The label's service: itself, by app name, else by the first app name that it contains."""
    return let(normalize_label(label), _service_of)


def _service_of(token: Column) -> Column:
    pairs = F.array(*[F.struct(F.lit(k).alias("app"), F.lit(v).alias("service")) for k, v in SERVICE_OF_APP.items()])
    contained = F.get(F.filter(pairs, lambda p: F.contains(token, p["app"])), F.lit(0))["service"]
    return F.coalesce(F.when(token.isin(*SERVICES), token), _lookup(SERVICE_OF_APP, token), contained, F.lit("unknown"))


def service_from_category(category: Column | str) -> Column:
    return let(normalize_label(category), lambda token: F.coalesce(_lookup(SERVICE_OF_CATEGORY, token), infer_service(token)))


def app_from_path(path: Column | str) -> Column:
    """The first known app whose token the path contains, else its folder's label. Paths are relative to the input root."""
    path = _column(path)
    found = let(F.lower(path), lambda text: F.coalesce(*[F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in PATH_TOKENS]))
    return F.coalesce(found, normalize_label(F.try_element_at(F.split(path, "/"), F.lit(-2))))


def protocol_number(protocol: Column | str) -> Column:
    text = F.lower(F.trim(_column(protocol).cast("string")))
    number = text.try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 2147483648.0)
    return (
        F.when(text.isin(*UDP_NAMES) | text.startswith("quic"), UDP)
        .when(text.isin(*TCP_NAMES) | text.startswith("tcp") | text.startswith("tls"), TCP)
        .when(finite, number.try_cast("int"))
        .otherwise(0)
    )


def is_private(address: Column | str) -> Column:
    """By prefix, as text; ``172.2`` is taken as it stands, so 172.200 to 172.255 count too. Null is not private."""
    address = _column(address)
    tests = [address.startswith(p) for p in PRIVATE_PREFIXES]
    found = tests[0]
    for test in tests[1:]:
        found = found | test
    return F.coalesce(found, F.lit(False))


def direction(source: Column | str, destination: Column | str) -> Column:
    """-1 from a public to a private address, else +1."""
    return F.when(~is_private(source) & is_private(destination), -1).otherwise(1)


def infer_condition(rtt: Column, jitter: Column, loss: Column) -> Column:
    score = F.lit(0)
    for value, limits in ((rtt, RTT_LIMITS), (jitter, JITTER_LIMITS), (loss, LOSS_LIMITS)):
        for limit in limits:
            score = score + F.when(value > limit, 1).otherwise(0)
    return F.when(score <= 0, "good").when(score <= 2, "moderate").when(score <= 4, "degraded").otherwise("bad")


def condition_index(condition: Column | str) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, CONDITIONS[:4])), _column(condition)), F.lit(0)).cast("int") - 1 + F.when(
        _column(condition).isin(*CONDITIONS[:4]), 0
    ).otherwise(5)


def stable_hash(*parts: Column) -> Column:
    """The first 52 bits of the parts' SHA-256, as a long."""
    digest = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def stable_seed(*parts: Column) -> Column:
    """The first 32 bits of the parts' SHA-256."""
    digest = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def stable_key(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone: the same on every retry and partitioning."""
    return stable_hash(*parts) / F.lit(float(1 << 52))


def protocol_flags(protocol: Column) -> tuple[Column, Column, Column]:
    tcp, udp = (protocol == TCP).cast("double"), (protocol == UDP).cast("double")
    return tcp, udp, udp
