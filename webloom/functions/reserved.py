"""Names that are no owners of repositories."""

# First path segments of the code host that are no owners.
RESERVED_OWNERS = (
    "settings", "explore", "trending", "collections", "events", "sponsors", "notifications", "marketplace", "pulls", "issues", "codespaces", "features",
    "enterprise", "organizations", "pricing", "about", "team", "security", "login", "join",
)
