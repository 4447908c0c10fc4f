"""Request validation and authentication decisions as columns."""

from __future__ import annotations

import hmac
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearfield.schema import LIMITS

# fixed values: the error texts of the service's interface
NOT_READY = "Not initialized"
NOT_JSON = "Invalid JSON body"
TOO_MANY = f"Batch size exceeds limit (max {LIMITS.batch})"
NO_TEXTS = "'texts' must be a non-empty array of strings"
NO_ITEMS = "'items' must be a non-empty array"
BAD_ITEM = "Each item must have 'id' and 'text'"
NO_QUERY = "'query' must be a non-empty string"
NO_IDS = "'ids' must be a non-empty array"
NO_NAMESPACE = "'namespace' must be a non-empty string"
UNHANDLED = "Internal Server Error"
TRUTHS = ("1", "true", "yes", "on")
BLANK = r"^[\s\p{Z}\x{1c}-\x{1f}\x{85}]*$"


def verdict(endpoint: str, body: Column, ready: bool = True) -> Column:
    """struct(status int, error string) for a JSON body sent to embed, index, search, remove or purge; error is null for 200.

    A body that is JSON but no object, and numbers that can't be read, are unhandled errors (500). Spaces of any script
    make a blank string. A null body is no JSON.
    """
    v = F.try_parse_json(body)
    kind = F.schema_of_variant(v)

    def is_a(path: str, name: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith(name), F.lit(False))

    def length(path: str) -> Column:
        return F.coalesce(F.size(F.try_variant_get(v, path, "array<variant>")), F.lit(0))

    def text(path: str) -> Column:
        return is_a(path, "STRING") & ~F.coalesce(F.try_variant_get(v, path, "string").rlike(BLANK), F.lit(True))

    def number(path: str, name: str) -> Column:
        """Absent, or readable as a number; an explicit null is not."""
        given = F.try_variant_get(v, path, "variant").isNotNull()
        return ~given | F.try_variant_get(v, path, name).isNotNull()

    def listed(path: str) -> Column:
        return is_a(path, "ARRAY") & (length(path) > 0)

    item_ok = F.forall(
        F.coalesce(F.try_variant_get(v, "$.items", "array<variant>"), F.array().cast("array<variant>")),
        lambda x: F.schema_of_variant(x).startswith("OBJECT") & F.try_variant_get(x, "$.id", "variant").isNotNull() & F.try_variant_get(x, "$.text", "variant").isNotNull(),
    )
    many = {"embed": length("$.texts"), "index": length("$.items")}
    rules = {
        "embed": [(~listed("$.texts"), 400, NO_TEXTS), (many["embed"] > LIMITS.batch, 400, TOO_MANY)],
        "index": [(~listed("$.items"), 400, NO_ITEMS), (many["index"] > LIMITS.batch, 400, TOO_MANY), (~item_ok, 400, BAD_ITEM)],
        "search": [(~text("$.query"), 400, NO_QUERY), (~(number("$.limit", "double") & number("$.min_similarity", "double")), 500, UNHANDLED)],
        "remove": [(~listed("$.ids"), 400, NO_IDS)],
        "purge": [(~text("$.namespace"), 400, NO_NAMESPACE)],
    }[endpoint]
    rules = [(v.isNull(), 400, NOT_JSON), (~kind.startswith("OBJECT"), 500, UNHANDLED), *rules]
    if not ready:
        rules = [(F.lit(True), 503, NOT_READY if endpoint != "embed" else "Provider not initialized"), *rules]
    out = F.struct(F.lit(200).alias("status"), F.lit(None).cast("string").alias("error"))
    for bad, status, error in reversed(rules):
        out = F.when(bad, F.struct(F.lit(status).alias("status"), F.lit(error).alias("error"))).otherwise(out)
    return out


# fixed values: the error texts of the tool interface
TOOL_NO_TEXTS = "'texts' must be a non-empty array"
TOOL_ITEMS = "items must be 1-100 entries"
TOOL_NO_QUERY = "query must be non-empty"
TOOL_NO_IDS = "ids must be non-empty"
TOOL_NO_NAMESPACE = "namespace is required"
TOOL_INVALID = "invalid arguments"
FALSY = ("null", "false", "0", "0.0", '""', "[]", "{}")


def tool_error(tool: str, arguments: Column) -> Column:
    """Error of a tool call with JSON arguments, null if it is accepted: looser rules than those of the requests.

    Only emptiness is tested where a request tests types: a string of ids passes, and so does a blank namespace. Values that
    the call would break on (a query that is no string, numbers that can't be read, items without a length, arguments
    that are no object) are invalid arguments.
    """
    v = F.try_parse_json(arguments)

    def kind(path: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("ABSENT"))

    def empty(path: str) -> Column:
        value = F.try_variant_get(v, path, "variant")
        return value.isNull() | F.to_json(value).isin(*FALSY)

    def number(path: str) -> Column:
        return (kind(path) == "ABSENT") | F.try_variant_get(v, path, "double").isNotNull()

    def listed(path: str) -> Column:
        return kind(path).startswith("ARRAY") & ~empty(path)

    size = F.when(kind("$.items").startswith("ARRAY"), F.size(F.try_variant_get(v, "$.items", "array<variant>"))).when(kind("$.items") == "STRING", F.char_length(F.try_variant_get(v, "$.items", "string"))).when(kind("$.items").startswith("OBJECT"), F.size(F.try_variant_get(v, "$.items", "map<string,variant>")))
    rules = {
        "embed": [(~listed("$.texts"), TOOL_NO_TEXTS), (F.size(F.try_variant_get(v, "$.texts", "array<variant>")) > LIMITS.batch, TOO_MANY)],
        "index": [(empty("$.items"), TOOL_ITEMS), (size.isNull(), TOOL_INVALID), (size > LIMITS.batch, TOOL_ITEMS)],
        "search": [(~(number("$.limit") & number("$.min_similarity")), TOOL_INVALID), (~kind("$.query").isin("STRING", "ABSENT"), TOOL_INVALID), (F.coalesce(F.try_variant_get(v, "$.query", "string").rlike(BLANK), F.lit(True)), TOOL_NO_QUERY)],
        "remove": [(empty("$.ids"), TOOL_NO_IDS)],
        "purge": [(empty("$.namespace"), TOOL_NO_NAMESPACE)],
    }.get(tool, [(F.lit(True), f"Unknown tool: {tool}")])
    out = F.lit(None).cast("string")
    for bad, error in reversed([(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), TOOL_INVALID), *rules]):
        out = F.when(bad, F.lit(error)).otherwise(out)
    return out


def texts_verdict(texts: Column) -> Column:
    """The same for the texts of an embed request that is a table row already."""
    n = F.coalesce(F.size(texts), F.lit(0))
    row = lambda s, e: F.struct(F.lit(s).alias("status"), F.lit(e).cast("string").alias("error"))
    return F.when(n <= 0, row(400, NO_TEXTS)).when(n > LIMITS.batch, row(400, TOO_MANY)).otherwise(row(200, None))


def bearer(header: Column) -> Column:
    """The credential of an Authorization header, or an empty string."""
    at = F.instr(header, " ")
    scheme = F.when(at > 0, F.substring(header, F.lit(1), at - 1)).otherwise(header)
    rest = F.when(at > 0, F.substring(header, at + 1, F.length(header))).otherwise("")
    return F.when(F.lower(scheme) == "bearer", F.regexp_replace(rest, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")).otherwise("")


def auth_status(header: Column, token: str, method: Column | None = None) -> Column:
    """200 or 401. No token configured: everything passes; OPTIONS always does. Reproduces the result, not the constant time."""
    if not token.strip():
        return F.lit(200)
    ok = F.coalesce(bearer(header) == token.strip(), F.lit(False))
    return F.when(ok if method is None else ok | (F.upper(method) == "OPTIONS"), 200).otherwise(401)


def token_matches(presented: str, expected: str) -> bool:
    """For a service's edge: constant time, an empty token never matches."""
    return bool(presented and expected) and hmac.compare_digest(presented.encode(), expected.encode())


def auth_required(value: str | None) -> bool:
    return (value or "").strip().lower() in TRUTHS


def startup_posture(token: str, require: bool) -> str:
    """'enabled' or 'open'; raises ValueError if a token is required and missing."""
    if token.strip():
        return "enabled"
    if require:
        raise ValueError("authentication is required but no token is configured")
    return "open"


def strict(value: object, kind: type, default: object) -> object:
    """value if it is of that kind, else the default; a bool is no number, an int passes as float."""
    if isinstance(value, bool):
        return value if kind is bool else default
    if kind is float and isinstance(value, int):
        return float(value)
    return value if isinstance(value, kind) else default


def auth_token(env: Mapping[str, str]) -> str:
    """The configured token of a mapping of settings; blanks alone mean none."""
    return env.get("NEARFIELD_AUTH_TOKEN", "").strip()


def check_startup(surface: str, host: str, env: Mapping[str, str]) -> str:
    """What a surface may say of its authentication when it starts; raises ValueError if a token is required and missing.

    The host is reported, and never taken for evidence that requests are local.
    """
    posture = startup_posture(auth_token(env), auth_required(env.get("NEARFIELD_REQUIRE_AUTH")))
    if posture == "enabled":
        return f"{surface}: bearer authentication enabled (bound to {host})"
    return f"{surface}: UNAUTHENTICATED, every request that reaches {host} is served"


class BearerGuard:
    """An ASGI application behind a bearer token: http and websocket scopes without it get a 401, OPTIONS and all other
    scopes pass. Without a token everything passes."""

    def __init__(self, app: Callable, token: str):
        self.app, self.token = app, token.strip()

    async def __call__(self, scope: dict, receive: Callable, send: Callable) -> None:
        guarded = self.token and scope["type"] in ("http", "websocket") and scope.get("method") != "OPTIONS"
        if guarded and not token_matches(self._presented(scope), self.token):
            if scope["type"] == "websocket":
                await send({"type": "websocket.close", "code": 1008})
                return
            body = b'{"error": "unauthorized"}'
            headers = [(b"content-type", b"application/json"), (b"content-length", str(len(body)).encode()), (b"www-authenticate", b"Bearer")]
            await send({"type": "http.response.start", "status": 401, "headers": headers})
            await send({"type": "http.response.body", "body": body})
            return
        await self.app(scope, receive, send)

    @staticmethod
    def _presented(scope: dict) -> str:
        for name, value in scope.get("headers", []):
            if name.lower() == b"authorization":
                scheme, _, rest = value.decode("latin-1").partition(" ")
                return rest.strip() if scheme.lower() == "bearer" else ""
        return ""
