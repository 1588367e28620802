"""Scalar rules on names, payloads and identities: all plain column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

# Kernel function names and the system call that each counts as.
KERNEL_NAMES = {
    "__x64_sys_execve": "execve",
    "__x64_sys_execveat": "execveat",
    "__x64_sys_connect": "connect",
    "__x64_sys_open": "open",
    "__x64_sys_openat": "openat",
    "__x64_sys_read": "read",
    "__x64_sys_write": "write",
    "__x64_sys_writev": "write",
    "__x64_sys_close": "close",
    "__x64_sys_setuid": "setuid",
    "__x64_sys_setgid": "setgid",
    "__x64_sys_capset": "capset",
    "__x64_sys_unshare": "unshare",
    "__x64_sys_mount": "mount",
    "__x64_sys_clone": "clone",
    "__x64_sys_clone3": "clone3",
    "__x64_sys_pivot_root": "pivot_root",
    "__x64_sys_ptrace": "ptrace",
    "__x64_sys_accept": "accept",
    "__x64_sys_accept4": "accept",
    "__x64_sys_bind": "bind",
    "__x64_sys_listen": "listen",
    "sys_execve": "execve",
    "sys_connect": "connect",
    "sys_open": "open",
    "sys_openat": "openat",
    "sys_read": "read",
    "sys_write": "write",
    "sys_writev": "write",
    "sys_close": "close",
    "sys_setuid": "setuid",
    "sys_setgid": "setgid",
    "sys_capset": "capset",
    "sys_unshare": "unshare",
    "sys_mount": "mount",
    "sys_clone": "clone",
    "sys_pivot_root": "pivot_root",
    "sys_ptrace": "ptrace",
    "sys_accept": "accept",
    "sys_accept4": "accept",
}
# Namespaces of the system.
SYSTEM_NAMESPACES = ("kube-system", "kube-public", "kube-node-lease", "cilium", "monitoring")
# Ends of the paths of shells and network tools.
NETWORK_BINARIES = ("/sh", "/bash", "/dash", "/zsh", "/ksh", "/busybox", "/curl", "/wget", "/nc", "/ncat", "/socat")
# Calls that may show an attack, and the least limit of each call's share.
LIMIT_FLOORS = {
    "execve": 0.02,
    "execveat": 0.02,
    "clone": 0.05,
    "clone3": 0.05,
    "unshare": 0.02,
    "mount": 0.02,
    "ptrace": 0.02,
    "setuid": 0.02,
    "setgid": 0.02,
    "capset": 0.02,
    "connect": 0.05,
}
BEHAVIOUR_SYSCALLS = tuple(LIMIT_FLOORS)
# Keys of a call's parameters that name a resource.
RESOURCE_KEYS = ("bucket", "database", "deployment", "endpoint", "file", "filename", "host", "namespace", "path", "pod", "resource", "secret", "service", "table", "uri", "url")
# Parts of the names of risky tools, and of risky resources.
RISKY_TOOLS = ("apply", "bash", "chmod", "chown", "delete", "drop", "exec", "kubectl", "patch", "privileged", "rm", "secret", "shell", "ssh", "token")
RISKY_RESOURCES = ("clusterrole", "credential", "kube-system", "secret", "serviceaccount", "token")
# Methods that call a tool.
TOOL_METHODS = ("tools/call", "tool/call")
# Technique, its name, confidence, the calls of which any counts, or all where so said.
TECHNIQUES = (
    ("T1059", "Command and Scripting Interpreter", "high", ("execve",), "any"),
    ("T1611", "Escape to Host", "high", ("unshare", "mount", "pivot_root"), "any"),
    ("T1046", "Network Service Discovery", "medium", ("connect",), "any"),
    ("T1548", "Abuse Elevation Control Mechanism", "high", ("setuid", "setgid", "capset"), "any"),
    ("T1496", "Resource Hijacking (Cryptomining)", "medium", ("clone",), "any"),
    ("T1041", "Exfiltration Over C2 Channel", "medium", ("connect", "openat"), "all"),
)
# A part of a pod's name and the role that it shows; the first that fits counts.
ROLES = (
    ("kafka-entity-operator", "kafka-operator"), ("kafka", "kafka-broker"), ("postgres", "postgresql"), ("rabbitmq", "rabbitmq"),
    ("redis-sentinel", "redis-sentinel"), ("redis", "redis"), ("minio", "minio"), ("waypoint", "istio-proxy"), ("istio", "istio-proxy"), ("frontend", "frontend"),
)
Z_ONE_SIDED, Z_TWO_SIDED = 1.6448536269514722, 1.959963984540054


def mapping(pairs: dict[str, str]) -> F.Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def syscall_name(function) -> F.Column:
    """the system call of a kernel function; null if it is none of those that count."""
    return mapping(KERNEL_NAMES)[function]


def event_seconds(text, arrival) -> F.Column:
    """seconds of an RFC 3339 time, without a zone read as UTC, finer digits cut; the arrival time if it is no time."""
    cut = F.regexp_replace(text, r"(\.\d{6})\d+", "$1")
    zoned = F.when(cut.rlike(r"(Z|[+-]\d\d:?\d\d)$"), cut).otherwise(F.concat(cut, F.lit("Z")))
    return F.coalesce(F.unix_micros(F.try_to_timestamp(zoned)) / 1e6, arrival)


def workload_of(pod_key) -> F.Column:
    """namespace/workload of namespace/pod: without rollout hash and suffix, else without a trailing ordinal."""
    rollout = r"^([^/]*/.*)-[0-9A-Za-z]{8,10}-[0-9A-Za-z]{5}$"
    ordinal = r"^([^/]*/.+)-[0-9]+$"
    return F.when(pod_key.rlike(rollout), F.regexp_extract(pod_key, rollout, 1)).when(pod_key.rlike(ordinal), F.regexp_extract(pod_key, ordinal, 1)).otherwise(pod_key)


def role_of(pod_name) -> F.Column:
    """the role that a pod's name shows."""
    name = F.lower(pod_name)
    rule = reduce(lambda w, r: w.when(name.contains(r[0]), r[1]), ROLES[1:], F.when(name.contains(ROLES[0][0]), ROLES[0][1]))
    return rule.when(name.rlike(r"-service$|-service-|api-gateway"), "stateless-http").otherwise("other-production")


def stable_workload(workload_key) -> F.Column:
    """a workload key without its namespace and container."""
    return F.substring_index(F.substring_index(workload_key, "/", -1), ":", 1)


def is_network_binary(binary) -> F.Column:
    """the path ends with a shell or a network tool."""
    return F.lower(binary).rlike("(" + "|".join(NETWORK_BINARIES) + ")$")


def hash_bin(value, bits: int) -> F.Column:
    """multiplicative hash of a whole number into 2**bits bins.

    Only the product's lower 32 bits count, so the number's are multiplied in halves: no product leaves a long.
    """
    low, high = value.cast("long").bitwiseAND(F.lit(0xFFFF)), F.shiftright(value.cast("long"), 16).bitwiseAND(F.lit(0xFFFF))
    product = low * F.lit(2654435761) + F.shiftleft((high * F.lit(2654435761)).bitwiseAND(F.lit(0xFFFF)), 16)
    return F.shiftrightunsigned(product.bitwiseAND(F.lit(0xFFFFFFFF)), 32 - bits).cast("long")


def hash_bin_pair(first, second, bits: int) -> F.Column:
    """F10 for a transition: the two numbers side by side."""
    return hash_bin(F.shiftleft(first.cast("long"), 16).bitwiseXOR(second.cast("long")), bits)


def contains_any(text, parts) -> F.Column:
    return F.lower(text).rlike("|".join(p.replace("-", r"\-") for p in parts))


def is_high_risk(tool, resources) -> F.Column:
    """a risky tool name, or a risky word in a resource."""
    return F.coalesce(contains_any(tool, RISKY_TOOLS), F.lit(False)) | F.coalesce(F.exists(resources, lambda r: contains_any(r, RISKY_RESOURCES)), F.lit(False))


def techniques(names) -> F.Column:
    """array of (id, name, confidence) that an array of system calls points to."""
    hit = {"any": lambda calls: F.arrays_overlap(names, F.array(*map(F.lit, calls))), "all": lambda calls: reduce(lambda a, b: a & b, [F.array_contains(names, c) for c in calls])}
    return F.array_compact(F.array(*[F.when(hit[how](calls), F.struct(F.lit(i).alias("id"), F.lit(n).alias("name"), F.lit(c).alias("confidence"))) for i, n, c, calls, how in TECHNIQUES]))


def sparse(vector, digits: int = 8) -> F.Column:
    """array of (i, v) where v is not 0."""
    return F.filter(F.transform(vector, lambda v, i: F.struct(i.cast("int").alias("i"), F.round(v.cast("double"), digits).alias("v"))), lambda x: x["v"] != 0)


def dense(pairs, size: int) -> F.Column:
    """F15 back: an array of size values."""
    values = F.map_from_entries(pairs)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at(values, i.cast("int")), F.lit(0.0)))


def wilson(count, total, z: float = Z_ONE_SIDED, upper: bool = False) -> F.Column:
    """A10: Wilson bound of a proportion; at least one trial is assumed, counts are drawn into the possible range;
    the lower bound of none is exactly 0, the upper bound of all exactly 1."""
    n = F.greatest(total.cast("double"), F.lit(1.0))
    p = F.least(F.greatest(count.cast("double"), F.lit(0.0)), n) / n
    centre, radius = p + z * z / (2 * n), z * F.sqrt(F.greatest(p * (1 - p) + z * z / (4 * n), F.lit(0.0)) / n)
    if upper:
        return F.when(p >= 1, 1.0).otherwise(F.least(F.lit(1.0), (centre + radius) / (1 + z * z / n)))
    return F.when(p <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), (centre - radius) / (1 + z * z / n)))


def wilson_sql(count: str, total: str, z: float = Z_ONE_SIDED, upper: bool = False) -> str:
    """The same as DuckDB SQL."""
    n = f"greatest(CAST({total} AS DOUBLE), 1.0)"
    p = f"(least(greatest(CAST({count} AS DOUBLE), 0.0), {n}) / {n})"
    centre, radius = f"({p} + {z * z} / (2 * {n}))", f"({z} * sqrt(greatest({p} * (1 - {p}) + {z * z} / (4 * {n}), 0.0) / {n}))"
    if upper:
        return f"CASE WHEN {p} >= 1 THEN 1.0 ELSE least(1.0, ({centre} + {radius}) / (1 + {z * z} / {n})) END"
    return f"CASE WHEN {p} <= 0 THEN 0.0 ELSE greatest(0.0, ({centre} - {radius}) / (1 + {z * z} / {n})) END"
