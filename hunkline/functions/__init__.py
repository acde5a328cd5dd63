"""Column functions (JVM-side expressions only, no Python UDFs)."""

from hunkline.functions.jsstr import (  # noqa: F401
    JS_SPACE,
    estimate_tokens,
    js_has_text,
    js_or,
    js_replace_first,
    js_trim,
    int_div,
    plural,
    strip_one_quote,
    utf16_length,
)
