"""URL functions: pattern lists compiled into boolean columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinflow.functions.base import col, contains_any, ends_with_any

#: Extensions of files that are not pages.
STATIC_EXTENSIONS = (
    ".css", ".js", ".json", ".xml", ".rss", ".atom", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".ico", ".pdf", ".zip", ".tar", ".gz", ".mp4",
    ".mp3", ".webm", ".woff", ".woff2", ".ttf", ".eot", ".map", ".txt",
)
#: Extensions of pages.
HTML_EXTENSIONS = (
    ".html", ".htm", ".php", ".asp", ".aspx", ".jsp", ".jspx", ".do", ".action", ".cgi", ".pl", ".shtml", ".xhtml", ".cfm", ".phtml",
)
#: What excludes a URL, by site and in general.
WIKIPEDIA_EXCLUDED = (
    "/w/load.php", "/w/api.php", "/w/index.php?title=", "action=edit", "action=history", "action=raw", "action=info", "action=render",
    "action=submit", "action=delete", "action=protect", "action=unprotect", "action=move", "special:recentchanges", "special:whatlinkshere",
    "special:export", "special:permalink", "special:search", "special:userlogin", "special:createaccount", "special:upload", "oldid=", "diff=",
    "printable=yes", "mobileaction=", "veaction=edit", "section=", "#", ".wikipedia.org/wiki/special:", "simple.wikipedia.org", "m.wikipedia.org",
    "en.m.wikipedia.org", "es.m.wikipedia.org", "wikimedia.org",
)
REDDIT_EXCLUDED = (
    "/r/", "/user/", "/comments/", "/wiki/", "/message/", "/submit/", "/login/", "/register/", "/settings/", "/prefs/", "/r/all/", "/r/popular/",
    "?sort=", "?limit=", "?after=", "?before=", "?context=", "?depth=", "/api/", "/embed/", "/saved/", "/upvoted/", "/downvoted/", "/hidden/",
    "/gilded/", "/submitted/",
)
GITHUB_EXCLUDED = (
    "/raw/", "/blob/", "/commit/", "/commits/", "/issues/", "/pull/", "/pulls/", "/actions/", "/projects/", "/wiki/", "/releases/", "/tags/",
    "/branches/", "/insights/", "/settings/", "/security/", "/labels/", "/milestones/", "/discussions/", "/sponsor/", "/account/", "/orgs/", "/new/",
    "/edit/", "/delete/", ".patch", ".diff", "?tab=", "#readme",
)
#: Fixed values. The mixed-case entries can't match a lower-cased URL; they are part of the list all the same.
GENERAL_EXCLUDED = (
    "/login", "/logout", "/signup", "/register", "/cart", "/checkout", "/wishlist", "/admin", "/dashboard", "/settings", "/preferences", "/api/",
    "/graphql", "/rest/", "/rpc/", "/feed", "/rss", "/atom", "/xmlrpc.php", "/cdn-cgi/", "/wp-json/", "/wp-content/", "?share=", "?utm_", "?ref=",
    "?source=", "javascript:", "mailto:", "tel:", "data:", ".git/", ".svn/", ".env/", ".idea/", "/amp/", "?format=amp", "/print/", "/mobile/",
    "/embed/", "/frame/", "/iframe/", "?iframe=", "/wiki/Wikipedia:", "/wiki/Portal:", "/wiki/Ayuda:", "/wiki/Especial:", "/wiki/Main_Page",
    "/wiki/Contents", "/wiki/Community_portal", "/wiki/Recent_changes", "/wiki/File:", "/wiki/Template:", "/wiki/Category:", "/wiki/Categor%C3%ADa",
    "/wiki/Help:", "/wiki/Special:",
)
#: Domains that are not searched.
SOCIAL_DOMAINS = (
    "facebook.com", "twitter.com", "x.com", "linkedin.com", "instagram.com", "pinterest.com", "tiktok.com", "snapchat.com", "reddit.com",
)
#: Where files can be had as they are.
RAW_HOSTS = ("raw.githubusercontent.com", "gist.githubusercontent.com", "raw.gitlab.com")
PASTEBINS = ("pastebin.com/raw/", "hastebin.com/raw/", "dpaste.com")
CODE_HOSTS = ("github.com", "gitlab.com", "bitbucket.org", "codeberg.org", "sr.ht", "gist.github.com")
RAW_EXTENSIONS = (
    ".py", ".js", ".ts", ".jsx", ".tsx", ".json", ".yaml", ".yml", ".toml", ".cfg", ".ini", ".sh", ".bash", ".md", ".txt", ".csv", ".log", ".env",
    ".xml", ".java", ".c", ".cpp", ".h", ".rs", ".go", ".rb", ".php", ".sql", ".r", ".m", ".swift", ".kt", ".scala", ".lua", ".vim", ".dockerfile",
    ".makefile", ".gradle", ".properties", ".conf", ".rst", ".adoc", ".tex", ".bib", ".svg", ".graphql", ".proto",
)
#: Domains whose pages lead on to each other.
KNOWLEDGE_DOMAINS = ("wikipedia.org", "wikimedia.org", "wiki", "readthedocs.io", "github.com", "docs.python.org", "developer.mozilla.org")

MAX_LENGTH = 500
MAX_PARAMETERS = 10


def scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(url), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def netloc(url: Column | str) -> Column:
    """Host with port and user, as written."""
    return F.regexp_extract(col(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def path(url: Column | str) -> Column:
    return F.regexp_extract(col(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(url: Column | str) -> Column:
    return F.regexp_extract(col(url), r"^[^?#]*\?([^#]*)", 1)


def is_domain_excluded(url: Column | str, domains=tuple(SOCIAL_DOMAINS)) -> Column:
    """The host, without www., is one of the domains or below one."""
    host = F.regexp_replace(F.lower(netloc(url)), r"^www\.", "")
    return host.isin(*domains) | ends_with_any(host, [f".{d}" for d in domains])


def is_crawlable(url: Column | str) -> Column:
    """A page worth fetching: by extension, by the lists of its site and in general, by length and parameters."""
    url = F.coalesce(col(url), F.lit(""))
    lower = F.lower(url)
    wiki = lower.contains("wikipedia.org")
    wiki_ok = ~contains_any(lower, WIKIPEDIA_EXCLUDED) & path(url).startswith("/wiki/") & (F.length(path(url)) >= 7)
    reddit = lower.contains("reddit.com") | lower.contains("redd.it")
    reddit_ok = ~contains_any(lower, REDDIT_EXCLUDED) & lower.contains("/comments/")
    names = F.transform(F.filter(F.split(query(url), "&"), lambda p: p.rlike("^[^=]*=.")), lambda p: F.regexp_extract(p, "^([^=]*)=", 1))
    return (
        (url != "")
        & ~ends_with_any(lower, STATIC_EXTENSIONS)
        & (~wiki | wiki_ok)
        & (~reddit | reddit_ok)
        & (~lower.contains("github.com") | ~contains_any(lower, GITHUB_EXCLUDED))
        & ~contains_any(lower, GENERAL_EXCLUDED)
        & (F.length(url) <= MAX_LENGTH)
        & (F.size(F.array_distinct(names)) <= MAX_PARAMETERS)
    )


def is_html(url: Column | str) -> Column:
    """No script, mail, phone or data link, and no extension but a page's."""
    url = F.coalesce(col(url), F.lit(""))
    last = F.regexp_extract(F.regexp_replace(path(url), "/+$", ""), "([^/]*)$", 1)
    ext = F.lower(F.regexp_extract(last, r"(\.[^.]*)$", 1))
    return (url != "") & ~url.rlike("^(javascript|mailto|tel|data):") & (~last.contains(".") | ext.isin(*HTML_EXTENSIONS))


def is_raw_file(url: Column | str) -> Column:
    url = F.coalesce(col(url), F.lit(""))
    host, lower = F.lower(netloc(url)), F.lower(url)
    direct = contains_any(host, RAW_HOSTS) | (host.contains("gitlab.com") & path(url).contains("/-/raw/")) | (host.contains("bitbucket.org") & path(url).contains("/raw/")) | contains_any(lower, PASTEBINS)
    named = ends_with_any(F.lower(F.regexp_replace(path(url), "/+$", "")), RAW_EXTENSIONS) | ends_with_any(lower, RAW_EXTENSIONS)
    return direct | (contains_any(host, CODE_HOSTS) & named)


def blob_to_raw(url: Column | str) -> Column:
    """The raw form of a file's page on two code hosts, else null."""
    url = col(url)
    hub, lab = r"(?i)^https?://github\.com/([^/]+)/([^/]+)/blob/([^/]+)/(.+)$", r"(?i)^(https?://gitlab\.com/[^/]+/[^/]+)/-/blob/([^/]+)/(.+)$"
    return F.when(url.rlike(hub), F.regexp_replace(url, hub, "https://raw.githubusercontent.com/$1/$2/$3/$4")).when(url.rlike(lab), F.regexp_replace(url, lab, "$1/-/raw/$2/$3"))


def ensure_scheme(url: Column | str) -> Column:
    url = col(url)
    return F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("https://"), url))


def origin(url: Column | str) -> Column:
    return F.concat(scheme(url), F.lit("://"), netloc(url))


def absolute_link(href: Column | str, base: Column | str) -> Column:
    """A link's target from the page's origin; null for anchors and scripts."""
    href = col(href)
    return (
        F.when((href == "") | href.startswith("#") | href.startswith("javascript:"), F.lit(None))
        .when(href.startswith("http"), href)
        .when(href.startswith("/"), F.concat(origin(base), href))
        .otherwise(F.concat(origin(base), F.lit("/"), href))
    )


def absolute_media(src: Column | str, base: Column | str) -> Column:
    src = col(src)
    rooted = F.when(src.startswith("/"), src).otherwise(F.concat(F.lit("/"), src))
    return F.when(src.startswith("//"), F.concat(F.lit("https:"), src)).when(src.startswith("http"), src).otherwise(F.concat(origin(base), rooted))


def media_key(url: Column | str) -> Column:
    """Media are the same whatever the query."""
    return F.regexp_replace(col(url), "[?#].*", "")


def unquote(text: Column | str) -> Column:
    """Percent escapes decoded; plus signs and what is no escape stay."""
    told = F.regexp_replace(F.replace(col(text), F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(told), col(text))


def filename(url: Column | str) -> Column:
    return unquote(F.regexp_extract(path(url), "([^/]*)$", 1))


def wikipedia_language(url: Column | str) -> Column:
    return F.regexp_extract(col(url), r"^https?://([a-z]+)\.wikipedia\.org/wiki/.+", 1)


def wikipedia_title(url: Column | str) -> Column:
    raw = F.regexp_extract(col(url), r"^https?://[a-z]+\.wikipedia\.org/wiki/(.+)", 1)
    return F.regexp_replace(F.regexp_replace(unquote(raw), "[#?].*$", ""), "/+$", "")


def thumbnail(url: Column | str, proxy: str, size: int) -> Column:
    quoted = F.replace(F.replace(F.url_encode(col(url)), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit(f"{proxy}?size={size}&url="), quoted)


def slug_text(url: Column | str) -> Column:
    return F.translate(F.lower(path(url)), "_-", "  ")


def has_slug(url: Column | str) -> Column:
    return F.exists(F.split(path(url), "/"), lambda p: p.rlike("[-_]"))


def mentions(url: Column | str, phrases: Column) -> Column:
    """Does the path name one of the phrases as whole words."""
    text = slug_text(url)
    return F.exists(phrases, lambda h: F.rlike(text, F.concat(F.lit(r"(?U)\b\Q"), F.lower(h), F.lit(r"\E\b"))))
