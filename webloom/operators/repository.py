"""Results of repository pages on the code host, from captured API records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import errors
from webloom.functions import url as U
from webloom.functions.text import base64_text
from webloom.operators.fetch import spare
from webloom.schemas import README_SCHEMA, REPO_SCHEMA

# Fields that a repository record must have, and below the labels of its summary.
REQUIRED = (
    "name", "full_name", "html_url", "stargazers_count", "forks_count", "open_issues_count", "default_branch", "created_at", "updated_at",
    "pushed_at", "archived", "fork", "owner.login", "owner.type",
)


def api_url(url: Column) -> Column:
    r = U.repository(url)
    return F.format_string("https://api.github.com/repos/%s/%s", r.owner, r.repo)


def api_error(owner: Column, repo: Column, status: Column) -> Column:
    """Text for a status that isn't 200 to 299; null for none."""
    return (
        F.when(status.isNull() | status.between(200, 299), None)
        .when(status == 404, F.format_string("Repository %s/%s not found", owner, repo))
        .when(status == 403, "GitHub API rate limit exceeded")
        .otherwise(F.format_string("GitHub API error: HTTP %d", status))
    )


def readme_text(status: Column, record: Column) -> Column:
    """Text of a README record, null unless all of it is as it should be."""
    r = F.from_json(record, README_SCHEMA)
    return F.when(status.between(200, 299) & (r.encoding == "base64"), base64_text(r.content))


def _line(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"- **{label}:** "), value.cast("string"), F.lit("\n"))


def markdown(repo: Column, readme: Column) -> Column:
    """Summary of a repository; lines whose value is missing are left out."""
    filled = lambda c: F.when(c != "", c)
    info = [
        _line("Stars", repo.stargazers_count), _line("Forks", repo.forks_count), _line("Open Issues", repo.open_issues_count), _line("Language", repo.language),
        _line("License", F.coalesce(repo.license.spdx_id, repo.license["name"])), _line("Topics", F.when(F.size(repo.topics) > 0, F.array_join(repo.topics, ", "))),
        _line("URL", repo.html_url), _line("Homepage", filled(repo.homepage)), _line("Default Branch", repo.default_branch),
        _line("Owner", F.concat(repo.owner.login, F.lit(" ("), repo.owner["type"], F.lit(")"))), _line("Status", F.when(repo.archived, "Archived")),
        _line("Fork", F.when(repo.fork, "Yes")), _line("Created", repo.created_at), _line("Last Updated", repo.updated_at), _line("Last Push", repo.pushed_at),
    ]
    top = [F.concat(F.lit("# "), repo.full_name, F.lit("\n\n")), F.concat(repo.description, F.lit("\n\n")), F.lit("## Repository Info\n\n")]
    return F.concat_ws("", *top, *info, F.concat(F.lit("\n---\n\n## README\n\n"), readme))


def repository_fields(captures: DataFrame, active: Column, known: Column | None = None) -> tuple[DataFrame, dict[str, Column]]:
    """The captures with helper columns, and the result fields of repository pages, whatever method or conversion was asked for.

    A network error is an error like that of any page; so is a capture without a record, which says nothing of the
    repository.
    """
    step = captures
    for name, kind in (("repo_status", "int"), ("repo_json", "string"), ("readme_status", "int"), ("readme_json", "string")):
        if name not in captures.columns:
            step = step.withColumn(name, F.lit(None).cast(kind))
    # a network error counts before any record; without either, nothing was captured
    p = spare(step.columns)
    step = step.withColumn(f"{p}repo_status", F.when(active & F.col("net_error").isNull(), F.col("repo_status")))
    status = F.col(f"{p}repo_status")
    ok = F.coalesce(status.between(200, 299), F.lit(False))
    step = step.withColumns({f"{p}repo": F.when(ok, F.from_json("repo_json", REPO_SCHEMA)), f"{p}readme": F.when(ok, readme_text(F.col("readme_status"), F.col("readme_json"))), f"{p}name": F.when(active, U.repository(F.col("url"), known))})
    repo = F.col(f"{p}repo")
    complete = F.lit(True)
    for name in REQUIRED:
        field = repo
        for part in name.split("."):
            field = field[part]
        complete = complete & field.isNotNull()
    step = step.withColumn(f"{p}fine", ok & F.coalesce(complete, F.lit(False)))
    fine = F.col(f"{p}fine")
    network = F.when(active, errors.network_kind(F.col("net_error")))
    missing = active & network.isNull() & status.isNull()
    kind = F.coalesce(network, F.when(missing | ok & ~fine, "FetcherError"))
    detail = F.when(network.isNotNull(), F.col("net_error")).when(missing, "No repository record was captured").otherwise("Failed to parse repo data")
    return step, {
        "url": F.col("url"),
        "status_code": F.when(~ok, status).when(fine, 200),
        "content_type": F.when(fine, "text/markdown"),
        "format": F.when(fine, "github_repo"),
        "content": F.when(fine, markdown(repo, F.col(f"{p}readme"))),
        "error": api_error(F.col(f"{p}name").owner, F.col(f"{p}name").repo, status),
        "error_kind": kind,
        "error_message": errors.message(kind, detail),
    }


def repository_response(captures: DataFrame) -> DataFrame:
    """Results of repository pages; see ``repository_fields``."""
    from webloom.operators.fetch import result

    step, fields = repository_fields(captures, F.lit(True))
    return result(step, fields, captures.columns)
