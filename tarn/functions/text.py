"""Expressions that produce or clean text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from . import as_col
from .rounding import hundredths, text_1


def format_size(size_bytes: Column | str) -> Column:
    """Bytes, or KB, MB or GB with up to two decimals; whole arithmetic up to 92 PB, never an exponent."""
    b = as_col(size_bytes)
    kb, mb = b < 1024**2, b < 1024**3
    shift = F.when(kb, 10).when(mb, 20).otherwise(30)
    unit = F.when(kb, " KB").when(mb, " MB").otherwise(" GB")
    text = (hundredths(b, shift).cast("decimal(20,0)") / F.lit(100)).cast("decimal(22,2)").cast("string")
    number = F.regexp_replace(text, r"(\.[0-9])0$", "$1")
    return F.when(b < 1024, F.concat(b.cast("string"), F.lit(" B"))).otherwise(F.concat(number, unit))


def format_duration(ms: Column | str) -> Column:
    m = as_col(ms)
    seconds = m / F.lit(1000.0)
    short = seconds < 60
    number = text_1(F.when(short, seconds).otherwise(seconds / F.lit(60.0)))
    unit = F.when(short, " s").otherwise(" min")
    return F.when(m.isNull() | (m == 0), "0 s").otherwise(F.concat(number, unit))


def format_ts(ts: Column | str) -> Column:
    return F.date_format(as_col(ts), K.TIMESTAMP_FORMAT)


def next_run_text(ts: Column | str) -> Column:
    return F.coalesce(format_ts(ts), F.lit(K.PAUSED))


def default_uploader(uploader: Column | str) -> Column:
    return F.coalesce(as_col(uploader), F.lit(K.UNKNOWN_UPLOADER))


def normalise_user(name: Column | str) -> Column:
    """Lower case, no outer whitespace, each inner space a dash."""
    outer = r"^[\s\p{Z}\x1c-\x1f\x85]+|[\s\p{Z}\x1c-\x1f\x85]+$"
    stripped = F.regexp_replace(F.lower(as_col(name)), outer, "")
    return F.replace(stripped, F.lit(" "), F.lit("-"))


def container_name(role: Column | str, user: Column | str) -> Column:
    return F.concat(as_col(role), F.lit("-"), as_col(user))


def job_id(name: Column | str) -> Column:
    return F.concat(F.lit(K.JOB_PREFIX), F.replace(as_col(name), F.lit(K.SCRIPT_SUFFIX), F.lit("")))


def first_lines(text: Column | str, n: int = K.PREVIEW_ROWS) -> Column:
    """The first ``n`` pieces between newlines, joined again."""
    return F.substring_index(as_col(text), "\n", n)


def driver_link(html: Column | str) -> Column:
    """Address of the driver page, without trailing slashes; NULL when there is none."""
    found = F.regexp_extract(as_col(html), "(?i)" + K.DRIVER_LINK_PATTERN, 1)
    return F.when(found != "", F.rtrim(found, F.lit("/")))


def rewrite_host(
    url: Column | str,
    internal: str = K.INTERNAL_STORE_URL,
    public: str = K.PUBLIC_STORE_URL,
) -> Column:
    return F.replace(as_col(url), F.lit(internal), F.lit(public))
