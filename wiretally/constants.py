"""The word lists, patterns and limits that define the results."""

# ---------------------------------------------------------------------------
# Traffic filter
# ---------------------------------------------------------------------------
JSON_CONTENT_TYPES = ["application/json", "application/vnd.api+json", "text/json"]
NOISE_PATHS = ["/monitoring", "/telemetry", "/track", "/manifest.json"]
NOISE_PREFIX = "/_next/static/"
EXTENSION_SCHEMES = ["chrome-extension://", "moz-extension://"]

TRACKER_HOSTS = [
    # analytics
    "google-analytics.com", "analytics.google.com", "googletagmanager.com", "segment.io",
    "cdn.segment.com", "mixpanel.com", "amplitude.com", "hotjar.com", "heapanalytics.com",
    "plausible.io", "posthog.com", "clarity.ms", "fullstory.com",
    # advertising
    "doubleclick.net", "googlesyndication.com", "googleadservices.com", "facebook.net",
    "connect.facebook.net", "adsrvr.org", "adnxs.com", "criteo.com", "outbrain.com",
    "taboola.com",
    # error tracking
    "sentry.io", "datadoghq.com", "browser-intake-datadoghq.com", "newrelic.com",
    "bam.nr-data.net", "logrocket.com", "logr-ingest.com", "bugsnag.com", "rollbar.com",
    # social pixels
    "bat.bing.com", "ct.pinterest.com", "snap.licdn.com", "px.ads.linkedin.com",
    "analytics.twitter.com", "analytics.tiktok.com",
    # customer engagement
    "intercom.io", "widget.intercom.io", "api-iam.intercom.io", "zendesk.com", "drift.com",
    "crisp.chat",
]

# ---------------------------------------------------------------------------
# Path templates. A noun keeps its word and names the next slots.
# ---------------------------------------------------------------------------
RESOURCE_SLOTS = {
    "repos": [":owner", ":repo"], "users": [":username"], "orgs": [":org"],
    "organizations": [":org"], "teams": [":team"], "members": [":member"],
    "projects": [":project"], "gists": [":gist_id"], "issues": [":issue_number"],
    "pulls": [":pull_number"], "commits": [":sha"], "branches": [":branch"], "tags": [":tag"],
    "releases": [":release_id"], "milestones": [":milestone"], "labels": [":label"],
    "hooks": [":hook_id"], "keys": [":key_id"], "deployments": [":deployment_id"],
    "environments": [":env"], "runs": [":run_id"], "jobs": [":job_id"],
    "artifacts": [":artifact_id"], "packages": [":package"],
    "posts": [":post_id"], "comments": [":comment_id"], "articles": [":article_id"],
    "stories": [":story_id"], "threads": [":thread_id"], "messages": [":message_id"],
    "channels": [":channel"], "videos": [":video_id"], "playlists": [":playlist_id"],
    "tracks": [":track_id"], "albums": [":album_id"], "artists": [":artist_id"],
    "images": [":image_id"], "files": [":file_id"], "documents": [":doc_id"],
    "folders": [":folder_id"], "collections": [":collection_id"], "categories": [":category"],
    "products": [":product_id"], "items": [":item_id"], "orders": [":order_id"],
    "customers": [":customer_id"], "carts": [":cart_id"], "stores": [":store_id"],
    "reviews": [":review_id"],
    "accounts": [":account_id"], "workspaces": [":workspace"], "databases": [":database"],
    "tables": [":table"], "namespaces": [":namespace"], "clusters": [":cluster"],
    "instances": [":instance"], "regions": [":region"], "zones": [":zone"],
    "resources": [":resource_id"], "subscriptions": [":subscription_id"],
    "tenants": [":tenant_id"], "groups": [":group_id"], "roles": [":role"],
    "policies": [":policy"], "tokens": [":token_id"], "sessions": [":session_id"],
    "events": [":event_id"], "logs": [":log_id"], "metrics": [":metric"],
    "alerts": [":alert_id"], "notifications": [":notification_id"], "webhooks": [":webhook_id"],
    "media": [":media_id"], "assets": [":asset_id"], "uploads": [":upload_id"],
}

STRUCTURAL_WORDS = [
    "api", "v1", "v2", "v3", "v4", "v5", "v6", "v7", "v8", "v9", "v10", "search", "filter", "sort", "query",
    "list", "create", "update", "delete", "status", "config", "settings", "preferences", "profile", "info",
    "details", "stats", "analytics", "count", "batch", "bulk", "export", "import", "auth", "login", "logout",
    "register", "signup", "signin", "callback", "oauth", "token", "refresh", "verify", "confirm", "reset",
    "activate", "public", "private", "internal", "external", "admin", "management", "graphql", "gql", "rest",
    "rpc", "ws", "websocket", "stream", "feed", "health", "ping", "version", "manifest", "metadata", "schema",
    "upload", "download", "preview", "thumbnail", "embed", "latest", "trending", "popular", "featured",
    "recommended", "top", "new", "web", "app", "mobile", "desktop", "data", "raw", "render", "consent",
    "wrapper", "widget", "integrity", "pathfinder", "rum",
]

# ---------------------------------------------------------------------------
# Tokens and entropy
# ---------------------------------------------------------------------------
UUID_RE = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
MIN_TOKEN_LENGTH = 16
ENTROPY_HIGH = 4.5
ENTROPY_MEDIUM = 3.5

# ---------------------------------------------------------------------------
# headers
# ---------------------------------------------------------------------------
STRIP_HEADERS = [
    "host", "connection", "keep-alive", "transfer-encoding", "upgrade", "te", "trailer", "x-forwarded-for",
    "x-forwarded-host", "x-forwarded-proto", "x-forwarded-port", "x-real-ip", "forwarded", "via",
    "proxy-authorization", "proxy-connection", "sec-ch-ua", "sec-ch-ua-mobile", "sec-ch-ua-platform",
    "sec-ch-ua-full-version-list", "sec-fetch-dest", "sec-fetch-mode", "sec-fetch-site", "sec-fetch-user",
    "accept-encoding", "cookie",
]
NEVER_AUTH_HEADERS = [
    "referer", "user-agent", "content-type", "accept", "accept-language", "origin", "host", "content-length",
    "cache-control", "pragma", "if-none-match", "if-modified-since", "dnt", "upgrade-insecure-requests",
    "traceparent", "tracestate", "tracecontext", "newrelic", "sentry-trace", "baggage", "x-request-id",
    "x-correlation-id", "x-trace-id", "x-span-id", "x-datadog-trace-id", "x-datadog-parent-id",
    "x-datadog-sampling-priority", "x-amzn-trace-id", "x-cloud-trace-context",
]
AUTH_HEADERS = [
    "authorization", "x-api-key", "x-guest-token", "x-csrf-token", "x-xsrf-token", "x-auth-token",
    "x-access-token", "x-session-token",
]
OBSERVER_AUTH_HEADERS = ["authorization", "x-api-key", "client-id", "x-auth-token"]
OBSERVER_AUTH_RE = r"bearer|token|apikey|api-key|auth"
OBSERVER_SKIP_HEADERS = [
    "cookie", "set-cookie", "content-type", "accept", "user-agent", "referer", "origin", "cache-control",
    "traceparent", "tracestate", "tracecontext", "newrelic", "content-length",
]
EXPORT_SENSITIVE_HEADERS = [
    "authorization", "x-api-key", "cookie", "set-cookie", "x-csrf-token", "x-xsrf-token",
]
SENSITIVE_QUERY_RE = r"(?i)api.?key|token|secret|credential|key|access.?key"
SENSITIVE_BODY_RE = (
    r"(?i)^(password|passwd|pass|secret|client_secret|refresh_token|access_token|api_key|apikey"
    r"|token|csrf_token|_csrf|xsrf_token|private_key|credential)$"
)

# ---------------------------------------------------------------------------
# Passive index admission
# ---------------------------------------------------------------------------
BLOCKED_SCHEMES = [
    "chrome-extension:", "chrome:", "devtools:", "data:", "blob:", "file:", "javascript:",
    "about:", "ws:", "wss:",
]
NOISE_URL_RE = r"__webpack|\.hot-update\.(?:json|js)$|/sockjs-node/|/ws$|/_next/webpack-hmr"
PRIVATE_HOST_RE = (
    r"^(?:localhost|127\.\d+\.\d+\.\d+|::1|0\.0\.0\.0|169\.254\.\d+\.\d+|10\.\d+\.\d+\.\d+"
    r"|172\.(?:1[6-9]|2\d|3[01])\.\d+\.\d+|192\.168\.\d+\.\d+)$"
)
# {b} stands for an ASCII word boundary, written in each engine's dialect
SENSITIVE_PATHS = [
    "/login", "/oauth", "/token", "/password", "/passwd", "/2fa", "/mfa", "/auth{b}",
    "/authenticate", "/authorization", "/session/new", "/signup", "/register", "/forgot",
    "/reset-password", "/verify-email", "/account/security", "/api-key", "/credentials",
    "/sso{b}", "/saml{b}", "/oidc{b}", "/connect/token", "/checkout", "/payment", "/billing",
    r"/\.well-known/openid", "/health{b}", "/metrics{b}", "/debug{b}",
]

# ---------------------------------------------------------------------------
# URL safety
# ---------------------------------------------------------------------------
INTERNAL_HOSTS = ["localhost"]
INTERNAL_SUFFIXES = [
    ".local", ".internal", ".localhost", ".corp", ".intranet", ".lan", ".test", ".invalid",
    ".example",
]
ALLOWED_METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"]

# ---------------------------------------------------------------------------
# pagination
# ---------------------------------------------------------------------------
OFFSET_PARAMS = ["offset", "skip"]
CURSOR_PARAMS = ["cursor", "after", "before", "next_cursor", "starting_after"]
PAGE_PARAMS = ["page", "p", "page_number"]
LIMIT_PARAMS = ["limit", "per_page", "page_size", "count", "size"]

# ---------------------------------------------------------------------------
# Body variables and refreshable tokens ({b} = word boundary)
# ---------------------------------------------------------------------------
DYNAMIC_KEY_PARTS = [
    "timestamp", "{b}time{b}", "{b}date{b}", "created[_-]?at", "updated[_-]?at",
    "{b}since{b}", "{b}until{b}", "{b}before{b}", "{b}after{b}", "{b}expires?{b}",
    "{b}cursor{b}", "{b}offset{b}", "{b}page{b}", "page[_-]?number",
    "next[_-]?token", "continuation",
    "request[_-]?id", "correlation[_-]?id", "trace[_-]?id", "{b}nonce{b}",
    "idempotency[_-]?key",
    "session[_-]?id", "{b}csrf{b}", "{b}xsrf{b}",
    "{b}geo(?:code|loc(?:ation)?){b}", "{b}lat(?:itude)?{b}", "{b}lo?ng(?:itude)?{b}",
    "{b}coord", "{b}zip{b}", "{b}postal",
    "{b}query{b}", "{b}search", "{b}keyword", "{b}term{b}", "{b}filter{b}",
]
REFRESHABLE_NAME_RE = r"(?i)csrf|token|nonce|xsrf|_token$"
REFRESHABLE_EXCLUDE_RE = r"(?i)access.?token|auth.?token|api.?token|bearer"
REFRESHABLE_VALUE_RE = r"^[a-fA-F0-9]{32,64}$|^[A-Za-z0-9+/]{20,}={0,2}$"

# ---------------------------------------------------------------------------
# Cookies and login
# ---------------------------------------------------------------------------
SESSION_COOKIE_RE = r"(?i)sess|auth|token|jwt|login|sid$|^_session|^connect\.sid$"
TRACKING_COOKIE_RE = r"(?i)^_ga|^_gid|^_fb|^_gcl|^__utm"
ANONYMOUS_COOKIE_RE = r"(?i)^anon|^guest|^visitor|^ab[_-]?test|^optanon|^consent"
TOKEN_URL_PARTS = [
    "/token{b}", "/oauth/token", "/oauth2/token", "/o/oauth2/token",
    r"securetoken\.googleapis\.com",
]
KEYED_TOKEN_HOST = "securetoken.googleapis.com"

# ---------------------------------------------------------------------------
# pages
# ---------------------------------------------------------------------------
NOISE_TAGS = ["script", "style", "noscript", "svg", "iframe", "nav", "header", "footer", "aside"]
SPA_MARKERS = [
    '<div id="root"', '<div id="app"', '<div id="__next"', "bundle.js", "main.js", "app.js",
    "__NEXT_DATA__", "window.__INITIAL_STATE__", "window.__NUXT__",
]
SPA_TEXT_LIMIT = 200
CONTENT_CLASSES = ["post-content", "article-body", "entry-content"]
AUTH_PATH_RE = r"(?i)/login|/signin|/sign-in|/auth/|/sso|/saml|/oauth|/cas/login"
OAUTH_LINK_RE = (
    r"(?i)accounts\.google\.com/o/oauth|github\.com/login/oauth|login\.microsoftonline\.com"
    r"|facebook\.com/v\d+.*/dialog/oauth|appleid\.apple\.com/auth"
)
SPEC_PATHS = [
    "/openapi.json", "/swagger.json", "/api-docs", "/api/docs", "/.well-known/openapi",
    "/v1/openapi.json", "/v2/openapi.json", "/v3/openapi.json", "/docs/api.json",
    "/api/swagger.json",
]
PROBE_PATHS = [
    "/api/", "/api/v1/", "/api/v2/", "/_api/", "/rest/", "/graphql", "/gql", "/api/graphql",
]
# Detectors: framework, confidence rule, signal, place (html or a header), text (None: the header is present), lower case.
FRAMEWORK_RULES = [
    ("WordPress", "count", "wp-json link", "html", "/wp-json/", False),
    ("WordPress", "count", "wp-content", "html", "/wp-content/", False),
    ("WordPress", "count", "wp-includes", "html", "/wp-includes/", False),
    ("WordPress", "count", "Link header", "link", "/wp-json/", False),
    ("WordPress", "count", "X-Powered-By", "x-powered-by", "wordpress", True),
    ("Shopify", "count", "Shopify CDN", "html", "cdn.shopify.com", False),
    ("Shopify", "count", "Shopify.theme", "html", "Shopify.theme", False),
    ("Shopify", "count", "myshopify domain", "html", "myshopify.com", False),
    ("Shopify", "count", "shopify-section", "html", "shopify-section", False),
    ("Next.js", "count", "__NEXT_DATA__", "html", "__NEXT_DATA__", False),
    ("Next.js", "count", "_next assets", "html", "/_next/", False),
    ("Next.js", "count", "X-Nextjs-Cache", "x-nextjs-cache", None, False),
    ("Next.js", "count", "X-Powered-By", "x-powered-by", "next.js", True),
    ("Nuxt", "count", "__NUXT__", "html", "__NUXT__", False),
    ("Nuxt", "count", "_nuxt assets", "html", "/_nuxt/", False),
    ("Nuxt", "count", "_payload.json", "html", "_payload.json", False),
    ("Nuxt", "count", "nuxt-link", "html", "nuxt-link", False),
    ("GraphQL", "count", "/graphql reference", "html", "/graphql", False),
    ("GraphQL", "count", "Apollo state", "html", "__APOLLO_STATE__", False),
    ("GraphQL", "count", "apollo-client", "html", "apollo-client", False),
    ("GraphQL", "count", "Relay", "html", "relay-", False),
    ("GraphQL", "count", "urql", "html", "urql", False),
    ("Drupal", "count", "X-Drupal-Cache", "x-drupal-cache", None, False),
    ("Drupal", "count", "X-Drupal-Dynamic-Cache", "x-drupal-dynamic-cache", None, False),
    ("Drupal", "count", "X-Generator", "x-generator", "drupal", True),
    ("Drupal", "count", "jsonapi", "html", "/jsonapi/", False),
    ("Drupal", "count", "drupal-settings", "html", "drupal-settings-json", False),
    ("Rails", "low", "Rails headers", "x-request-id", None, False),
    ("Rails", "low", "Rails headers", "x-runtime", None, False),
    ("Rails", "low", "Phusion", "x-powered-by", "phusion", True),
    ("Django", "low", "Django-like headers", "x-frame-options", None, False),
    ("Django", "low", "Django-like headers", "vary", "Cookie", False),
    ("Django", "low", "CSRF middleware", "html", "csrfmiddlewaretoken", False),
    ("Django", "low", "django reference", "html", "django", False),
    ("Laravel", "medium", "Laravel meta", "html", "csrf-token", False),
    ("Laravel", "medium", "Laravel meta", "html", "laravel", False),
    ("Laravel", "medium", "laravel_session", "set-cookie", "laravel_session", False),
    ("Strapi", "high", "X-Powered-By", "x-powered-by", "strapi", True),
]
FRAMEWORK_PATHS = {
    "WordPress": [
        "/wp-json/wp/v2/posts", "/wp-json/wp/v2/pages", "/wp-json/wp/v2/categories",
        "/wp-json/wp/v2/tags", "/wp-json/wp/v2/media", "/wp-json/wp/v2/users",
        "/wp-json/wp/v2/comments", "/wp-json/wp/v2/search",
    ],
    "Shopify": ["/products.json", "/collections.json", "/cart.json", "/search/suggest.json"],
    "Next.js": ["/api/"],
    "Nuxt": ["/api/", "/_payload.json"],
    "GraphQL": ["/graphql", "/gql", "/api/graphql"],
    "Drupal": ["/jsonapi/node/article", "/jsonapi/node/page", "/jsonapi/taxonomy_term"],
    "Rails": ["/api/v1/"],
    "Django": ["/api/", "/api/v1/", "/rest/"],
    "Laravel": ["/api/", "/api/v1/"],
    "Strapi": ["/api/", "/api/content-types", "/api/articles", "/api/pages"],
}

# ---------------------------------------------------------------------------
# specs
# ---------------------------------------------------------------------------
HTTP_METHODS = ["get", "post", "put", "patch", "delete", "head", "options", "trace"]
COUNTED_METHODS = ["get", "post", "put", "patch", "delete"]
SPEC_FILENAMES = ["openapi.json", "openapi.yaml", "swagger.json", "swagger.yaml"]
SPEC_REPO_RE = r"(?i)api-spec|api-schema|openapi|swagger|rest-api|api-schemas|openapi-spec"
PLACEHOLDER_HOSTS = ["localhost", "127.0.0.1", "example.com", "petstore.swagger.io"]

# ---------------------------------------------------------------------------
# limits
# ---------------------------------------------------------------------------
SCHEMA_MAX_DEPTH = 5
MAX_ENDPOINTS_PER_DOMAIN = 500
STALE_DAYS = 90
DELETE_DAYS = 180
DOMAIN_CAP = 500
INDEX_STALE_HOURS = 24
SIGNATURE_MAX_DAYS = 180
STALE_REPO_DAYS = 3 * 365
IDLE_SECONDS = 15
PLATEAU_IDLE_SECONDS = 10
PLATEAU_MAX_SECONDS = 120
PROMOTION_DEFAULT = 3
PROMOTION_MIN = 2
PROMOTION_MAX = 20
PROMOTION_BACKOFF_MINUTES = 30
RATE_LIMIT = 60
RATE_WINDOW_MS = 60_000
DEFAULT_DOM_BYTES = 400_000
DEFAULT_MAX_BYTES = 50_000
STRING_CAP = 500
TRUNCATED_SUFFIX = "... [truncated]"
SKELETON_CONFIDENCE = 0.8
BODY_CUT_BYTES = 512 * 1024
ELEMENT_LIMIT = 100
ELEMENT_TEXT_LIMIT = 200

# Characters of a spec operation's id.
SPEC_ID_CHARS = 80
