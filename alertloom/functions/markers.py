"""Word lists and patterns that decide how alerts are classified. They must stay as they are."""

# Words that make an alert a scan.
SCAN = ("scan", "probe", "probing", "sweep", "enumeration", "dirb", "wpscan", "gobuster", "nikto")
SCAN_TOOLS = ("dirb", "gobuster", "nikto")
WEB_ERRORS = (
    "web server 400 error",
    "web server 401 error",
    "web server 403 error",
    "web server 404 error",
    "multiple web server",
)
PROTOCOL_ANOMALIES = (
    "invalid record",
    "invalid handshake",
    "invalid reply",
    "no server welcome",
    "unable to match response",
)
# Words of credential guessing.
BRUTE_FORCE = (
    "brute force",
    "bruteforce",
    "password guess",
    "password guessing",
    "password spray",
    "login fail",
    "authentication fail",
    "multiple failed",
    "repeated failed",
    "invalid user",
    "online cracking",
)
# Words of DNS tunnels and floods.
DNS_TUNNEL = ("dns tunnel", "dns tunneling", "dns exfil", "dns data exfiltration", "dnsteal")
FLOOD = ("denial of service", "dos attack", "ddos", "syn flood", "request flood", "connection flood")
# Weak evidence that may join a confirmed web scan.
WEAK_WEB = (
    "new characters in apache access request",
    "new event type",
    "new status code in apache access log",
    "unusual occurrence frequencies of apache",
    "attempt to access forbidden file or directory",
    "attempt to access forbidden directory index",
    "suspicious url access",
    "common web attack",
    "web server 500 error",
)
WEB_CONTEXT = ("apache", "http/", "web ", "url", "access.log", "error.log")
# Keys that hold DNS names, and patterns of log lines.
DNS_NAME_KEYS = ("rrname", "qname", "query_name", "queryname", "hostname")
APACHE_STATUS = r'(?i)"(?:GET|HEAD|POST|PUT|DELETE|OPTIONS|PATCH)\s+\S+\s+HTTP/\d(?:\.\d)?"\s+(\d{3})\b'
LEADING_IP = r"^\s*([0-9a-fA-F:.]+)\s"
APACHE_CLIENT = r"(?i)\[client\s+((?:\d{1,3}\.){3}\d{1,3}|[0-9a-fA-F:]+)(?::\d+)?\]"
TUNNEL_CONTROL = r"^\d+[xX]\d+-$"
TUNNEL_SEQUENCE = r"^\d+-$"
# The vendor's Chinese markers and the hints they stand for, first match wins.
VENDOR_HINTS = (
    (
        "brute force password guessing",
        ("暴力猜解", "暴力破解", "账号爆破", "账户爆破", "口令爆破", "密码爆破", "口令猜解", "密码猜解", "弱口令"),
    ),
    ("dns tunnel", ("dns隧道", "dns 隧道", "域名隧道")),
    (
        "denial of service",
        ("拒绝服务", "ddos", "dos攻击", "dos 攻击", "syn洪泛", "syn 洪泛", "请求洪泛", "连接洪泛"),
    ),
    ("scan", ("扫描", "端口探测", "主机探测", "目录枚举", "服务探测")),
)
VENDOR_LOG_TYPES = (("webids-ids_dolog", "network_ids"), ("webids-webattack_dolog", "web_ids"))
# Evaluation-only fields that no feature may hold.
LABEL_FIELDS = ("label", "event_label", "time_label", "triage_label", "has_attack_event_label")
# Services that name a protocol.
PROTOCOLS = ("tcp", "udp", "icmp", "icmpv6", "http", "https", "dns", "tls", "ssh", "smtp", "imap", "pop3", "ftp")
# Keys whose values are masked as a whole.
TOKEN_KEYS = ("token", "secret", "nonce", "session", "cookie", "authorization")
TIME_KEY_PARTS = ("timestamp", "datetime", "notbefore", "notafter", "eventtime")
TIME_KEYS = (
    "time", "date", "event_time", "event_date", "created", "created_at", "updated", "updated_at", "expires", "expires_at", "expiry",
)
ID_KEYS = ("id", "uid", "pid", "uuid", "tx_id", "flow_id", "request_id", "session_id", "user_id")
NUMBER_KEY_PARTS = ("length", "bytes_", "pkts_", "count")


def _key_rule(parts: tuple[str, ...] = (), whole: tuple[str, ...] = (), ends: tuple[str, ...] = ()) -> str:
    return "(?s)(?:" + "|".join([*(f".*{x}.*" for x in parts), *whole, *(f".*{x}" for x in ends)]) + ")"


#: What a lower-cased key tells of its value, as a mask and a pattern of the whole key; the first that fits counts.
KEY_RULES = (
    ("<TOKEN>", _key_rule(TOKEN_KEYS)),
    ("<TIMESTAMP>", _key_rule(TIME_KEY_PARTS, TIME_KEYS, ("_time", "_date"))),
    ("<ID>", _key_rule((), ID_KEYS, ("_uuid", "_uid"))),
    ("<NUMBER>", _key_rule(NUMBER_KEY_PARTS)),
)
PAYLOAD_KEYS = ("payload", "request", "url", "command", "query", "raw_log_data", "affected_paths", "affected_values")
_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_DAY = "(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)"
_CLOCK = r"[0-2]\d:[0-5]\d:[0-6]\d"
_BYTE = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
# Masks in the order in which they apply. They hold for Java and Python alike.
MASKS = (
    ("<JWT>", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?![A-Za-z0-9_-])"),
    ("<UUID>", r"(?i)(?<![0-9a-f])[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}(?![0-9a-f])"),
    ("<MAC>", r"(?i)(?<![0-9a-f])(?:[0-9a-f]{2}:){5}[0-9a-f]{2}(?![0-9a-f])"),
    ("<EMAIL>", r"(?i)(?<![\w.+-])[\w.+-]+@[a-z0-9.-]+\.[a-z]{2,}(?![\w.-])"),
    ("<TIMESTAMP>", rf"(?i)(?<!\w)\d{{1,2}}/{_MONTH}/\d{{4}}:{_CLOCK}\s+[+-]\d{{4}}(?!\w)"),
    ("<TIMESTAMP>", rf"(?i)\b{_DAY},\s+\d{{1,2}}\s+{_MONTH}\s+\d{{4}}\s+{_CLOCK}\s+(?:GMT|UTC|[+-]\d{{4}})\b"),
    ("<TIMESTAMP>", rf"(?i)\b\d{{4}}-\d{{2}}-\d{{2}}[T ]{_CLOCK}(?:\.\d+)?(?:Z|[+-]\d{{2}}:?\d{{2}})?\b"),
    ("<TIMESTAMP>", rf"(?i)\b(?:{_DAY}\s+)?{_MONTH}\s+\d{{1,2}}\s+{_CLOCK}(?:\s+\d{{4}})?\b"),
    ("<TIMESTAMP>", r"(?<!\d)\d{4}-\d{2}-\d{2}(?!\d)"),
    ("<TIMESTAMP>", r"(?<![\d.])1\d{9}(?:\.\d{1,9})?(?![\d.])|(?<![\d.])1\d{12}(?![\d.])"),
    ("<TIMESTAMP>", rf"(?<!\d){_CLOCK}(?:\.\d+)?(?!\d)"),
    ("<PID>", r"(?<=\[)\d+(?=\])"),
    ("<IPV4>", rf"(?<![\w.]){_BYTE}(?:\.{_BYTE}){{3}}(?![\w.])"),
    ("<IPV6>", r"(?i)(?<![\w:])(?:[0-9a-f]{0,4}:){2,7}[0-9a-f]{0,4}(?![\w:])"),
    ("<SHA256>", r"(?i)(?<![0-9a-f])[0-9a-f]{64}(?![0-9a-f])"),
    ("<SHA1>", r"(?i)(?<![0-9a-f])[0-9a-f]{40}(?![0-9a-f])"),
    ("<MD5>", r"(?i)(?<![0-9a-f])[0-9a-f]{32}(?![0-9a-f])"),
    ("<HEX>", r"(?i)(?<![0-9a-f])[0-9a-f]{16,}(?![0-9a-f])"),
)
_CODE = "[A-Za-z0-9+/_-]"
#: A long run of code characters that has padding, or small letters, capitals and digits.
ENCODED_TOKEN = (
    r"(?<![A-Za-z0-9+/=_-])"
    rf"(?:{_CODE}{{24,}}={{1,2}}|(?={_CODE}*[a-z])(?={_CODE}*[A-Z])(?={_CODE}*[0-9]){_CODE}{{24,}})"
    r"(?![A-Za-z0-9+/=_-])"
)
QUERY_VALUE = r"(?i)((?:[?&;]|\b)([a-z][\w.-]*)=)([^&#;\s]+)"
PLACEHOLDER = "(?:" + "|".join(dict.fromkeys([*(mask for mask, _ in MASKS), "<NUMBER>", "<TOKEN>", "<ID>"])) + ")"
#: Fixed value: tokens of a payload template.
SIGNATURE_TOKEN = r"(?i)<[^>]{1,48}>|[a-z0-9_]+|[\x{4e00}-\x{9fff}]+"
