"""URL algebra as Column expressions. One RFC 3986 pattern; nothing raises on odd input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Groups: scheme, authority, path, query, fragment. The same pattern works in RE2.
PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
#: Groups: host name (brackets kept), port.
AUTHORITY = r"^(?:.*@)?(\[[^\]]*\]|[^:]*)(?::([0-9]*))?$"
SPACE_CLASS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
EDGE_SPACE = f"^{SPACE_CLASS}+|{SPACE_CLASS}+$"

#: Hosts that are never crawled, with their subdomains.
BLOCKED = sorted(
    "alipay.com baidu.com bilibili.com bing.com douban.com douyin.com facebook.com google.com instagram.com jd.com kuaishou.com mp.weixin.qq.com pinduoduo.com qq.com sm.cn so.com sogou.com taobao.com tieba.baidu.com tmall.com twitter.com weibo.com weixin.qq.com x.com xiaohongshu.com youtube.com zhihu.com".split()
)
#: Path segments of pages that serve the site rather than the reader.
FUNCTIONAL = sorted(
    "about account ad ads all api assets categories category comment comments contact css download faq feed help hot images img index js list login logout more page print privacy rank register rss search setting settings share signin signup sitemap static tag tags terms top upload user".split()
)
#: Endings of files that aren't pages.
FILES = sorted(
    "7z apk avi bin bmp css csv deb dmg doc docx eot exe flv gif gz ico ipa iso jpeg jpg js json mkv mov mp3 mp4 msi pdf pkg png ppt pptx rar rpm svg swf tar ttf webp wmv woff woff2 xls xlsx xml zip".split()
)
FILE_END = rf"\.({'|'.join(FILES)})$"


def trim(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), EDGE_SPACE, "")


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, PARTS, 1))


def authority(u: Column) -> Column:
    return F.regexp_extract(u, PARTS, 2)


def path(u: Column) -> Column:
    return F.regexp_extract(u, PARTS, 3)


def query(u: Column) -> Column:
    return F.regexp_extract(u, PARTS, 4)


def port(u: Column) -> Column:
    return F.regexp_extract(authority(u), AUTHORITY, 2)


def hostname(u: Column) -> Column:
    """Lower-case host name without port, userinfo or one final dot."""
    return F.regexp_replace(F.lower(F.regexp_extract(authority(u), AUTHORITY, 1)), r"\.$", "")


def is_web(u: Column) -> Column:
    return scheme(u).isin("http", "https") & (hostname(u) != "")


def host_of(u: Column) -> Column:
    """The lower-case host with its port; empty if there is none."""
    return F.lower(F.regexp_replace(F.coalesce(authority(u), F.lit("")), "^.*@", ""))


def host_key(u: Column) -> Column:
    """The host with a port that isn't the scheme's own, null for anything but web addresses."""
    usual = (port(u) == "") | ((scheme(u) == "http") & (port(u) == "80")) | ((scheme(u) == "https") & (port(u) == "443"))
    return F.when(is_web(u), F.concat(hostname(u), F.when(usual, F.lit("")).otherwise(F.concat(F.lit(":"), port(u)))))


def normalize(raw: Column) -> Column:
    """Lower-case scheme and host, own port and fragment dropped, query kept; null for anything but web addresses."""
    u = trim(raw)
    q = F.when(F.instr(F.regexp_replace(u, "#.*$", ""), "?") > 0, F.concat(F.lit("?"), query(u))).otherwise("")
    return F.when(is_web(u), F.concat(scheme(u), F.lit("://"), host_key(u), path(u), q))


def is_blocked(host: Column) -> Column:
    pattern = "(^|[.])(" + "|".join(b.replace(".", "[.]") for b in BLOCKED) + ")[.]?$"
    return F.lower(host).rlike(pattern)


def seed_host(raw: Column) -> Column:
    """The bare host that a line of a seed list names; null if it names none or a blocked one."""
    t = trim(raw)
    u = F.when(F.instr(t, "://") > 0, t).otherwise(F.concat(F.lit("http://"), t))
    h = hostname(u)
    good = (t != "") & ~t.startswith("#") & scheme(u).isin("http", "https") & F.contains(h, F.lit(".")) & ~is_blocked(h)
    return F.when(good, h)


def seed_url(raw: Column) -> Column:
    """The address that a line of a seed file stands for; null for blank lines and remarks."""
    t = trim(raw)
    return F.when((t != "") & ~t.startswith("#"), F.when(F.instr(t, "://") > 0, t).otherwise(F.concat(F.lit("http://"), t)))


def segments(u: Column) -> Column:
    return F.filter(F.split(F.lower(path(u)), "/"), lambda s: s != "")


def is_functional(u: Column) -> Column:
    return F.arrays_overlap(segments(u), F.array(*map(F.lit, FUNCTIONAL)))


def has_numeric_param(u: Column) -> Column:
    """Whether some parameter's value is a number of 2 to 18 digits."""
    value = lambda kv: F.regexp_replace(F.regexp_extract(kv, "^[^=]*=(.*)$", 1), EDGE_SPACE, "")
    return F.exists(F.split(query(u), "&"), lambda kv: value(kv).rlike("^[0-9]{2,18}$"))


def looks_like_article(u: Column) -> Column:
    segs = segments(u)
    last = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(F.try_element_at(segs, F.lit(-1)), F.lit("")), r"\.html$", ""), r"\.htm$", ""), r"\.shtml$", "")
    bad = F.lower(path(u)).rlike(FILE_END) | is_functional(u) | F.exists(segs, lambda s: s.startswith("page") | s.startswith("p_"))
    dated = F.exists(segs, lambda s: (F.octet_length(s) == 4) & s.rlike("[0-9]"))
    deep = (F.size(segs) >= 2) & (last.rlike("[0-9]") | (F.length(last) >= 8) | dated)
    return ~bad & (deep | has_numeric_param(u))


def _inner(u: Column) -> Column:
    return F.regexp_replace(path(u), "^/+|/+$", "")


def rank(u: Column) -> Column:
    """How much an address looks like one piece of content."""
    p = _inner(u)
    segs = F.split(p, "/")
    last = F.element_at(segs, -1)
    one = lambda cond, n: F.when(cond, n).otherwise(0)
    return (
        one(last.rlike("[0-9]"), 3) + one(F.length(last).between(6, 60), 2) + F.size(segs) + one(last.rlike(r"\.(s?html|htm)$"), 1) + one(query(u) != "", 1) + one(F.contains(p, F.lit("/20")), 1)
    ).cast("int")


def depth(u: Column) -> Column:
    """Slashes within the trimmed path."""
    p = _inner(u)
    return F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))
