"""A Python data source that lands the responses of configured endpoints, one row per page."""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from unisource.functions.text import PAGE_MARK
from unisource.operators.sage import CLOUD_RESOURCES, X3_FOLDER, X3_OBJECTS
from unisource.schemas import LANDED

# ---- fixed values: default endpoint and request options of the services ----
DEFAULT_ENDPOINTS = [{"path": "/", "entity_name": "root"}]
TIMEOUT_SECONDS = 10
REQUEST_OPTIONS = {
    "dynamics_entities": {
        "$select": "LogicalName,DisplayName,PrimaryIdAttribute,PrimaryNameAttribute,IsCustomEntity",
        "$filter": "IsIntersect eq false",
    },
    "dynamics_attributes": {
        "$select": "LogicalName,DisplayName,AttributeType,IsPrimaryId,IsPrimaryName,RequiredLevel",
    },
    "sage_cloud": {"$top": "1"},
}
# Request paths of the services, below their base address.
SERVICE_PATHS = {
    "odata": "/$metadata",
    "sap_odata": "/sap/opu/odata/sap/{name}/$metadata",
    "sap_services": "/sap/opu/odata/IWFND/CATALOGSERVICE/ServiceCollection",
    "dynamics_entities": "/api/data/v9.2/EntityDefinitions",
    "dynamics_attributes": "/api/data/v9.2/EntityDefinitions(LogicalName='{name}')/Attributes",
    "dynamics_edmx": "/api/data/v9.2/$metadata",
    "sage_x3": "/api/x3/erp/{folder}/{name}/$descriptor",
    "sage_cloud": "/{name}",
}
# Where replies of these dialects name their next page.
NEXT_PAGE = ("@odata.nextLink", "odata.nextLink", "__next")
PAGED = ("odata_rows", "dynamics_entities", "dynamics_attributes", "sap_services")


def service_endpoints(dialect: str, names: list[str] | None = None, folder: str = X3_FOLDER) -> list[dict]:
    """Endpoints to scan for one dialect: one per name where its path has a name in it.

    Without names, SAGE falls back to the objects or resources it reads by default.
    """
    if names is None:
        names = {"sage_x3": X3_OBJECTS, "sage_cloud": list(CLOUD_RESOURCES)}.get(dialect, [""])
    template = SERVICE_PATHS[dialect]
    return [{"path": template.format(name=n, folder=folder), "entity_name": n or dialect} for n in names]


@dataclass
class Endpoint(InputPartition):
    path: str
    entity: str
    params: dict

    def __init__(self, path: str, entity: str, params: dict):
        super().__init__(0)
        self.path, self.entity, self.params = path, entity, params


class EndpointReader(DataSourceReader):
    """One task per endpoint; a failing endpoint becomes a row, not a failed task.

    Replies of a dialect in PAGED are followed to their last page. Pages land one by one, so a task holds one
    at a time; page n > 1 has `#page=n` behind its path. Following ends at a link that was followed before,
    at a failing page, which lands with its status, and at a link to another server, which lands without
    status: the headers may hold secrets and are sent to the endpoint's own server only.
    """

    def __init__(self, options: dict):
        self.source_id = options.get("source_id", "")
        self.dialect = options.get("dialect", "rest")
        self.base_url = options["base_url"].rstrip("/")
        self.headers = json.loads(options.get("headers", "{}"))
        self.timeout = float(options.get("timeout", TIMEOUT_SECONDS))
        self.params = REQUEST_OPTIONS.get(self.dialect, {})
        given = options.get("endpoints")
        self.endpoints = json.loads(given) if given else DEFAULT_ENDPOINTS

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality on path or entity_hint leaves out requests; Spark checks the rest."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("path",):
                self.endpoints = [e for e in self.endpoints if e.get("path", "/") == f.value]
            elif isinstance(f, EqualTo) and f.attribute == ("entity_hint",):
                self.endpoints = [e for e in self.endpoints if _entity(e) == f.value]
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        return [
            Endpoint(e.get("path", "/"), _entity(e), {**self.params, **e.get("params", {})})
            for e in self.endpoints
        ]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not isinstance(partition, Endpoint):
            return
        url = self.base_url + partition.path
        if partition.params:
            url += "?" + urllib.parse.urlencode(partition.params, safe="$,")
        server, seen, page = urllib.parse.urlsplit(url)[:2], set(), 0
        while url and url not in seen:
            seen.add(url)
            page += 1
            if urllib.parse.urlsplit(url)[:2] == server:
                status, body = self.fetch(url)
            else:
                status, body = None, f"next page on another server: {url}"
            path = partition.path if page == 1 else f"{partition.path}{PAGE_MARK}{page}"
            yield (self.source_id, self.dialect, partition.entity, path, status, body)
            url = next_page(url, body) if self.dialect in PAGED and status is not None and status < 400 else None

    def fetch(self, url: str) -> tuple[int | None, str | None]:
        """Status and text of one reply; without a reply no status and the reason."""
        status, body = None, None
        try:
            request = urllib.request.Request(url, headers=self.headers)
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                charset = reply.headers.get_content_charset() or "utf-8"
                status, body = getattr(reply, "status", None) or 200, reply.read().decode(charset, "replace")
        except urllib.error.HTTPError as e:
            status, body = e.code, e.read().decode("utf-8", "replace")
        except (OSError, ValueError) as e:
            body = str(e)
        return status, body


def next_page(url: str, body: str | None) -> str | None:
    """Address of the page after this one, if the reply names one."""
    try:
        doc = json.loads(body or "")
    except ValueError:
        return None
    for part in (doc, doc.get("d")) if isinstance(doc, dict) else ():
        for name in NEXT_PAGE:
            link = part.get(name) if isinstance(part, dict) else None
            if isinstance(link, str) and link:
                return urllib.parse.urljoin(url, link)
    return None


def _entity(endpoint: dict) -> str:
    return endpoint.get("entity_name") or endpoint.get("path", "/").strip("/") or "data"


class EndpointSource(DataSource):
    """Format `unisource_endpoints`; options base_url, source_id, dialect, endpoints, headers, timeout."""

    @classmethod
    def name(cls) -> str:
        return "unisource_endpoints"

    def schema(self) -> str:
        return LANDED

    def reader(self, schema) -> DataSourceReader:
        return EndpointReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EndpointSource)
