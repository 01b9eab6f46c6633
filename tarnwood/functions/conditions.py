"""Branch conditions and sources by their parts: the call, its receiver, the comparison's sides and operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .findings import one_of

#: Characters that a shell acts on, and names that tell a test by themselves.
SHELL_MARKS = (";", "|", "&", "`", "$", ">", "<")
ERROR_CALLS, NULL_CALLS, EMPTY_CALLS = ("is_err", "is_ok"), ("is_none", "is_some"), ("is_empty", "isempty")
MEMBER_CALLS = ("includes", "include?", "contains", "indexof", "has", "in_array")
TYPE_CALLS = ("isinstance", "matches", "is_numeric", "is_int", "is_string", "is_float", "is_a?", "kind_of?")
NULLS = ("none", "null", "nil")


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group)


def parts(condition: Column) -> Column:
    """text, callee, leaf, receiver, left, op, right, needle of a condition, in lower case; '' for what it has not.

    callee is the first call's name, leaf its last part; left, op and right are of the first comparison; needle is a quoted first argument of the first call."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.trim(condition), r"^(if|elif|while|unless)\b", ""), r"(\bthen\b.*|[:{]\s*)$", ""))
    text = F.when(text.rlike(r"^\([^()]*(\([^()]*\)[^()]*)*\)$"), F.regexp_replace(text, r"^\(|\)$", "")).otherwise(text)
    low = F.lower(text)
    compare = r"^(.*?)\s*(===|!==|==|!=|<=|>=|<|>|\bis not\b|\bis\b)\s*(.*)$"
    callee = _found(low, r"([a-z_$][\w.:$?]*)\s*\(")
    leaf = _found(callee, r"([^.:]*)$")
    return F.struct(
        low.alias("text"), callee.alias("callee"), leaf.alias("leaf"), F.substring(callee, F.lit(1), F.length(callee) - F.length(leaf)).alias("receiver"),
        F.regexp_replace(F.lower(F.regexp_replace(_found(text, r"([A-Za-z_$][\w.:$?]*)\s*\("), "([a-z0-9])([A-Z])", "$1_$2")), "^.*[.:]", "").alias("snake"),
        _found(low, compare, 1).alias("left"), _found(low, compare, 2).alias("op"), F.trim(_found(low, compare, 3)).alias("right"), _found(text, r"\(\s*[\"']([^\"']*)[\"']").alias("needle"), low.rlike(r"\(\s*[\"']").alias("quoted"),
    )


def condition_kind(condition: Column) -> Column:
    """What a branch condition tests; the first kind that fits counts, and Unknown is preferred to a test in the wrong sense."""
    p = parts(condition)
    text, leaf, op, left, right = p.text, p.leaf, p.op, p.left, p.right
    equal = op.isin("==", "===", "!=", "!==")
    member = leaf.isin(*MEMBER_CALLS)
    mark = p.needle.isin(*SHELL_MARKS) & leaf.isin("contains", "includes", "include?") | F.regexp_extract(text, "^[\"'](.)[\"'] in ", 1).isin(*SHELL_MARKS)
    length = left.rlike(r"(\.length|\.len\(\)|\.size\(\))$|^len\(.*\)$|^strlen\(.*\)$")
    return (
        F.when(F.length(condition) == 0, "Unknown")
        .when(leaf.isin(*ERROR_CALLS) | (equal & (right == "nil") & left.rlike("(^|[^a-z])err(or)?$")), "ErrorCheck")
        .when(leaf.isin(*NULL_CALLS) | ((equal | op.isin("is", "is not")) & right.isin(*NULLS)), "NullCheck")
        .when(leaf.isin(*EMPTY_CALLS) | (equal & length & (right == "0")) | ((op == "==") & right.isin("''", '""')), "EmptyCheck")
        .when(mark | text.rlike(r"\[0\]\s*==\s*[\"']-[\"']"), "ShellMetaValidated")
        .when(leaf.isin("startswith", "starts_with") & (p.needle == "/"), "RelativeUrlValidated")
        .when(op.isin("==", "===") & F.concat_ws(" ", left, right).rlike(r"(url|urlparse|parse)\(.*\)\.(host|hostname|netloc)\b"), "HostAllowlistValidated")
        .when(member & p.quoted, "Unknown")
        .when(leaf.isin("indexof", "search", "find") & ((op.isin("==", "===", "<=") & (right == "-1")) | ((op == "<") & (right == "0"))), "Unknown")
        .when(member | text.rlike(r"\S\s+in\s+\S"), "AllowlistCheck")
        .when((leaf == "matches") & p.callee.rlike("matcher") & p.receiver.rlike("regex|pattern"), "ValidationCall")
        .when(leaf.isin(*TYPE_CALLS) | text.rlike(r"\btypeof\s|\sinstanceof\s|ctype_"), "TypeCheck")
        .when(length & op.isin("<", "<=", ">", ">=") & right.rlike("^[0-9]+$"), "BoundedLength")
        .when(leaf.rlike("valid|check|verify") | p.snake.rlike("^is_(safe|authorized|authenticated)") | (leaf.isin("test", "match", "matches") & p.receiver.rlike("regex|pattern")), "ValidationCall")
        .when(leaf.rlike("sanitiz|escape|encode"), "SanitizerCall")
        .when(~op.isin("", "is", "is not"), "Comparison")
        .otherwise("Unknown")
    )


def lowered(condition: Column) -> Column:
    """kind (Comparison, NullCheck, TypeCheck, BoolTest, Unknown), lhs, op, rhs, positive of a condition's atom."""
    p = parts(condition)
    null = p.right.isin(*NULLS) & (p.op != "")
    kind = F.when(null, "NullCheck").when(~p.op.isin("", "is", "is not"), "Comparison").when(p.leaf.isin("isinstance", "is_a?", "kind_of?") | p.text.rlike(r"\stypeof\s|\sinstanceof\s"), "TypeCheck").when(F.length(F.trim(p.text)) > 0, "BoolTest").otherwise("Unknown")
    two = kind.isin("Comparison", "NullCheck")
    return F.struct(kind.alias("kind"), F.when(two, F.trim(p.left)).alias("lhs"), F.when(two, p.op).alias("op"), F.when(two, p.right).alias("rhs"), F.lit(True).alias("positive"))


#: Each operator and its contrary.
CONTRARY = {"==": "!=", "!=": "==", "===": "!==", "!==": "===", "<": ">=", ">=": "<", ">": "<=", "<=": ">", "is": "is not", "is not": "is"}


def negated(atom: Column) -> Column:
    """The contrary of a lowered atom; a bare test keeps its form, as its branch tells its sense."""
    positive = F.when(atom.kind == "TypeCheck", ~atom.positive).otherwise(atom.positive)
    return F.struct(atom.kind.alias("kind"), atom.lhs.alias("lhs"), one_of(atom.op, CONTRARY).alias("op"), atom.rhs.alias("rhs"), positive.alias("positive"))


#: What a program reads from outside: framework, the names under which its documentation gives the call or attribute, and what that is.
READS = [
    ("Flask", "Cookie", "request.cookies", "session"), ("Flask", "Header", "request.headers"), ("Flask", "UserInput", "request.args", "request.form", "request.values", "request.json", "request.get_json", "request.data", "request.files"),
    ("Flask", "EnvironmentConfig", "app.config", "current_app.config"),
    ("Django", "Cookie", "request.COOKIES", "request.session"), ("Django", "Header", "request.META"), ("Django", "UserInput", "request.GET", "request.POST", "request.FILES", "request.body"), ("Django", "EnvironmentConfig", "django.conf.settings"),
    ("Express", "Cookie", "req.cookies", "req.signedCookies", "req.session"), ("Express", "Header", "req.headers", "req.header"), ("Express", "UserInput", "req.query", "req.params", "req.body", "req.files"),
    ("Koa", "Cookie", "ctx.cookies"), ("Koa", "Header", "ctx.headers"), ("Koa", "UserInput", "ctx.query", "ctx.params", "ctx.body", "ctx.request.body"),
    ("Go net/http", "Cookie", "r.Cookie", "r.Cookies"), ("Go net/http", "Header", "r.Header"), ("Go net/http", "UserInput", "r.FormValue", "r.PostFormValue", "r.URL.Query", "r.Body"),
    ("Java servlets", "Cookie", "request.getCookies", "request.getSession"), ("Java servlets", "Header", "request.getHeader", "request.getHeaders"), ("Java servlets", "UserInput", "request.getParameter", "request.getParameterValues", "request.getQueryString", "request.getReader", "request.getInputStream"),
    ("Rails", "Cookie", "cookies"), ("Rails", "UserInput", "params"),
    ("PHP", "Cookie", "$_COOKIE", "$_SESSION"), ("PHP", "Header", "getallheaders"), ("PHP", "UserInput", "$_GET", "$_POST", "$_REQUEST", "$_FILES"), ("PHP", "EnvironmentConfig", "$_ENV"), ("PHP", "FileSystem", "file_get_contents"),
    ("the DOM", "Cookie", "document.cookie"), ("the DOM", "UserInput", "window.location", "document.location", "document.referrer"),
    ("Python", "UserInput", "sys.argv", "sys.stdin", "input", "socket.recv", "socket.recvfrom"), ("Python", "EnvironmentConfig", "os.environ", "os.getenv", "configparser.ConfigParser", "config.get"), ("Python", "FileSystem", "open"),
    ("Node", "UserInput", "process.argv", "process.stdin"), ("Node", "EnvironmentConfig", "process.env"), ("Node", "FileSystem", "fs.readFile", "fs.readFileSync", "fs.createReadStream"),
    ("C", "UserInput", "argv", "fgets", "gets", "scanf", "recv", "recvfrom"), ("C", "EnvironmentConfig", "getenv"), ("C", "FileSystem", "fopen", "fread"),
    ("DB-API", "Database", "cursor.fetchone", "cursor.fetchmany", "cursor.fetchall", "fetchone", "fetchmany", "fetchall"), ("JDBC", "Database", "stmt.execute", "stmt.executeQuery", "resultSet.getString"),
]
#: Kinds in the order in which they are tried: what carries authority, then input, settings, files, stores.
KINDS = ("Cookie", "Header", "UserInput", "EnvironmentConfig", "FileSystem", "Database")


def source_kind(callee: Column, file_io: Column) -> Column:
    """The kind of source behind a dotted name: one of READS whole, or with segments around it. Files count if the call has that capability."""
    dotted = F.regexp_replace(F.regexp_replace(callee, r"::|->|\[", "."), r"[^A-Za-z0-9_$.]+", "")
    name = F.concat(F.lit("."), dotted, F.lit("."))
    out = None
    for kind in KINDS:
        hit = F.exists(F.array(*[F.lit(f".{n}.") for _, k, *names in READS if k == kind for n in names]), lambda n: F.contains(name, n))
        if kind == "FileSystem":
            hit = hit & file_io
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("Unknown")
