"""Catalogue index to registry: header aliases, completed items, keyed upsert, download decisions."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T

# Index fields and the normal forms of their headers.
ALIASES = {
    "ano": ["ano"],
    "id_dgert": ["id", "iddocumento"],
    "titulo": ["titulododocumento", "titulo"],
    "tipo": ["tipodedocumento", "tiposubtipodoc"],
    "volume": ["nvolumedoboletim", "novolumedoboletim", "nvolumebte"],
    "num_bte": ["ndoboletim", "nodoboletim", "nbte"],
    "data_bte": ["datadoboletim", "databte"],
    "data_distribuicao": ["datadedistribuicaodoboletim", "datadistribuicaobte"],
    "pagina": ["paginanaversaoescrita", "pagversaoescrita"],
    "cae": ["cae"],
    "cod_irct": ["codirct", "codigogepdgert"],
    "sectores": ["sectoresdeactividade", "setoresdeatividade", "setoresatividade", "sectoresatividade"],
    "outorgantes": ["outorgantes", "outorgantes1"],
    "altera": ["docsalteradosporeste", "docalteradosporeste", "docsalteradosporeste2", "docalteradosporeste2"],
    "alterado_por": ["docsquealteramestes", "docsquealteramestee", "docsquealterameste", "docalterameste", "docsalteramestes"],
    "em_vigor": ["documentosemvigor", "docsemvigor"],
    "url_em_vigor": ["linkdocemvigor", "linkparaodocumentoemvigor"],
    "url": ["linkparaodocumentocriado", "linkparaodocumento", "urlpdf"],
    "ficheiro": ["paginacriado", "nomepdf"],
    "cod_irct_base": [],
    "portaria_dr": [],
}
ACCUMULATED = ("altera", "alterado_por")
NAMING_STATES = ("nomeado", "ja_existente", "por_nomear", "por_confirmar", "conflito", "sem_origem")
STATE_FIELDS = "estado:string,data:string,bytes:bigint,sha256:string,etag:string,last_modified:string,caminho:string,erro:string,motivo:string"


def normal_header(name: str) -> str:
    """The header's letters and digits, lower case and without accents."""
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", name or "").lower() if c.isalnum())


def project_index(rows: DataFrame, header: list[str] | None = None, cells: str = "cells") -> DataFrame:
    """Index rows (cells: array in header order) as the named fields; other columns stay. Without `header`, rows have their own.

    Of several columns with one meaning the first with a value counts; ACCUMULATED fields join all distinct values. Rows
    with neither title nor address go.
    """
    names = [normal_header(h) for h in header or ()]
    own = [c for c in rows.columns if c != cells and not (header is None and c == "header")]
    if header is None:
        rows = rows.withColumn("x_pairs", F.arrays_zip(F.transform("header", lambda h: T.normal_name(h)).alias("n"), F.transform(cells, lambda c: T.strip(c)).alias("v")))
    fields = {}
    for field, known in ALIASES.items():
        if header is None:
            found = F.transform(F.filter("x_pairs", lambda z: z["n"].isin(known)), lambda z: z["v"]) if known else F.array().cast("array<string>")  # noqa: B023
        else:
            mine = [T.strip(F.get(cells, F.lit(i))) for i, n in enumerate(names) if n in known]
            found = F.array(*mine) if mine else F.array().cast("array<string>")
        values = F.filter(found, lambda v: F.coalesce(v, F.lit("")) != "")
        fields[field] = F.array_join(F.array_distinct(values), "; ") if field in ACCUMULATED else F.coalesce(F.get(values, F.lit(0)), F.lit(""))
    out = rows.select(*own, *[v.alias(k) for k, v in fields.items()]).filter("titulo <> '' or url <> ''")
    return out.withColumn("familia", T.family("tipo"))


def complete_items(items: DataFrame) -> DataFrame:
    """Items with year, number, file, address and key (chave) derived, and problem for those that can't be (null: valid)."""
    url = T.strip("url")
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    given = T.strip("ficheiro")
    bad_name = ((given != "") & T.safe_name(given).isNull()) | ((given == "") & (url != "") & (F.size(parts) > 0) & T.safe_name(path).isNull())
    name = F.coalesce(T.safe_name(F.nullif(given, F.lit(""))), F.when(url != "", T.safe_name(path)))
    from_url = lambda k: F.when((url != "") & (F.size(parts) >= k), T.whole_number(F.get(parts, F.size(parts) - k)))
    year, number = F.coalesce(T.whole_number("ano"), from_url(3)), F.coalesce(T.whole_number("num_bte"), from_url(2))
    made = F.when((url == "") & name.isNotNull() & (year != 0) & (number != 0), F.concat_ws("/", F.lit(P.DOCUMENT_URL), year.cast("string"), number.cast("string"), name))
    out = items.withColumns({"ano": year, "num_bte": number, "ficheiro": name, "url": F.coalesce(F.nullif(url, F.lit("")), made, F.lit("")), "bad_name": bad_name})
    problem = (
        F.when(F.col("bad_name"), "nome de ficheiro inválido no índice")
        .when(F.coalesce((F.col("ano") < 1900) | (F.col("num_bte") < 1), F.lit(True)) | F.col("ano").isNull() | F.col("num_bte").isNull(), "ano ou número BTE ausente ou inválido")
        .when(~F.coalesce(F.lower("ficheiro").rlike(r".\.pdf$"), F.lit(False)), "nome de PDF ausente ou inválido")
    )
    return out.withColumn("problem", problem).drop("bad_name").withColumn("chave", item_key())


def item_key() -> Column:
    """year/number/name: the file's stem, else the catalogue id, else the title's first letters."""
    stem = F.regexp_replace(F.coalesce("ficheiro", F.lit("")), r"(?<=.)\.[^.]*$", "")
    base = F.coalesce(F.nullif(stem, F.lit("")), F.nullif(T.normal_name("id_dgert"), F.lit("")), F.substring(T.normal_name("titulo"), 1, 40))
    return F.concat_ws("/", F.coalesce(F.col("ano").cast("string"), F.lit("None")), F.coalesce(F.col("num_bte").cast("string"), F.lit("None")), base)


def registry_errors(entry: str = "entry") -> Column:
    """Array of what is wrong with a registry entry (JSON text); other fields are free."""
    value = lambda p: F.get_json_object(F.col(entry), p)
    integer = lambda p: value(p).isNotNull() & ~value(p).rlike(r"^-?\d+(?:\.0+)?$")
    one_of = lambda p, ok: value(p).isNotNull() & ~value(p).isin(*ok)
    checks = [
        (F.coalesce(value("$.chave"), F.lit("")) == "", "chave"), (integer("$.ano"), "ano"), (integer("$.num_bte"), "num_bte"),
        (one_of("$.descarga.estado", P.DOWNLOAD_STATES), "descarga.estado"), (one_of("$.nomeacao.estado", NAMING_STATES), "nomeacao.estado"),
        (integer("$.nomeacao.ordinal") | (value("$.nomeacao.ordinal").try_cast("double") < 1), "nomeacao.ordinal"),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for bad, name in checks]), lambda x: x.isNotNull())


def load_registry(lines: DataFrame, text: str = "value", order: str = "line_no") -> tuple[DataFrame, DataFrame]:
    """(chave, entry) of a JSON lines registry with the last line of a key, and the rejected lines with their errors."""
    rows = lines.filter(T.strip(text) != "").select(order, F.col(text).alias("entry"))
    errors = F.when(F.try_parse_json("entry").isNull() | ~F.col("entry").rlike(r"^\s*\{"), F.array(F.lit("json"))).otherwise(registry_errors())
    rows = rows.withColumn("errors", errors)
    good = rows.filter(F.size("errors") == 0).withColumn("chave", F.get_json_object("entry", "$.chave"))
    return good.groupBy("chave").agg(F.max_by("entry", order).alias("entry")), rows.filter(F.size("errors") > 0)


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("x_last", F.row_number().over(w)).filter("x_last = 1").drop("x_last")


def upsert(registry: DataFrame, items: DataFrame, fields: list[str], key: str = "chave") -> DataFrame:
    """Registry rows with the items' non-empty fields put over theirs; new keys are added."""
    filled = {f: F.when(F.col(f).cast("string") != "", F.col(f)) for f in fields}
    fresh = items.select(key, *[v.alias(f"n_{f}") for f, v in filled.items()])
    joined = registry.join(fresh, key, "full")
    rest = [c for c in registry.columns if c != key and c not in fields]
    return joined.select(key, *[F.coalesce(f"n_{f}", f if f in registry.columns else F.lit(None)).alias(f) for f in fields], *rest)


def decide(items: DataFrame, registry: DataFrame, network: bool = False, families: tuple = P.ALL_FAMILIES, limit: int | None = None, order: str = "posicao") -> DataFrame:
    """chave, estado, motivo of each item; `descarregar` marks those to fetch, in order up to the limit.

    registry: chave, sha256 (recorded), local_sha256 (of the file at hand, null without one).
    """
    unknown = set(families) - set(P.ALL_FAMILIES)
    if unknown:
        raise ValueError(f"unknown families: {sorted(unknown)}")
    rows = items.join(registry.select("chave", "sha256", "local_sha256"), "chave", "left")
    state = (
        F.when(F.col("familia").isNull(), "ignorado").when(~F.col("familia").isin(*families), "ignorado").when(F.col("url") == "", "falhado")
        .when(F.col("sha256") == F.col("local_sha256"), "ja_existente").when(F.lit(not network), "por_descarregar").otherwise("descarregar")
    )
    kind = F.coalesce(F.nullif(F.col("tipo"), F.lit("")), F.lit("(sem tipo)"))
    why = (
        F.when(F.col("familia").isNull(), F.concat(F.lit("tipo desconhecido: "), kind))
        .when(~F.col("familia").isin(*families), F.concat(F.lit("família fora do âmbito: "), F.col("familia"))).when(F.col("url") == "", "sem URL")
    )
    rows = rows.withColumns({"estado": state, "motivo": why})
    if limit is not None and network:
        fetch = F.col("estado") == "descarregar"
        # Only rows to fetch are ranked: a row's rank is one more than the fetches before it.
        first = rows.filter(fetch).orderBy(order, "chave").limit(limit).select("chave", order).withColumn("chosen", F.lit(True))
        rows = rows.join(first, ["chave", order], "left").withColumn("estado", F.when(fetch & F.col("chosen").isNull(), "por_descarregar").otherwise(F.col("estado"))).drop("chosen")
    return rows.select("chave", "tipo", order, "estado", "motivo")


def download_outcome(url: Column, status: Column, body: Column, recorded: Column, local: Column) -> Column:
    """struct(estado, erro) of one response: only a PDF with status 200 that meets no unrecorded other file is stored."""
    bad = T.url_error(url)
    erro = (
        F.when(bad.isNotNull(), F.concat(F.lit("URL: "), bad)).when(status.isNull(), "sem resposta").when(status == 304, "HTTP 304 sem cópia local verificada")
        .when(status != 200, F.concat(F.lit("HTTP "), status.cast("string"))).when(F.substring(body, 1, 4) != F.lit(b"%PDF"), "a resposta não é um PDF")
        .when(local.isNotNull() & recorded.isNull() & (local != F.sha2(body, 256)), "conflito: PDF local sem hash registado; não foi substituído")
    )
    return F.struct(F.when(erro.isNull(), "descarregado").otherwise("falhado").alias("estado"), erro.alias("erro"))


def retries(status: Column) -> Column:
    """Whether a response is worth another try: no answer or a server's fault."""
    return status.isNull() | (~status.isin(200, 304) & ~status.between(400, 499))


class TooLarge(Exception):
    """A response beyond the size limit."""


class _Checked(urllib.request.HTTPRedirectHandler):
    """Follows a redirect to an allowed address only."""

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        if not allowed_url(newurl):
            raise urllib.error.URLError("redirect")
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def allowed_url(url: str) -> bool:
    """text.url_error's rules on one address, for redirects that come up inside a request."""
    try:
        parts = urllib.parse.urlsplit(url)
        return parts.scheme.lower() == "https" and (parts.hostname or "").lower() in P.ALLOWED_HOSTS and parts.username is None and parts.password is None and parts.port in (None, 443)
    except ValueError:
        return False


def url_fetcher(timeout: float = 60.0, most_bytes: int = 200 << 20) -> Callable[[str, dict], tuple[int | None, dict, bytes]]:
    """A fetcher over HTTPS: (status, headers, body); a null status for no answer. Redirects are checked, bodies are limited."""

    def get(url: str, headers: dict) -> tuple[int | None, dict, bytes]:
        opener = urllib.request.build_opener(_Checked)
        try:
            with opener.open(urllib.request.Request(url, headers={"User-Agent": "vellum", **headers}), timeout=timeout) as r:
                body = r.read(most_bytes + 1)
                if len(body) > most_bytes:
                    raise TooLarge(f"resposta acima de {most_bytes} bytes")
                return r.status, dict(r.headers), body
        except urllib.error.HTTPError as exc:
            return exc.code, dict(exc.headers or {}), b""
        except (OSError, TooLarge):
            return None, {}, b""

    return get


def fetch(items: DataFrame, fetcher: Callable[[str, dict], tuple[int | None, dict, bytes]], attempts: int = 3, pause: float = 1.0, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """chave, url, status, headers, body, sha256 by an injected fetcher, which runs on the executors; allowed addresses only.

    items: chave, url, and where known etag, last_modified and at_hand (whether the recorded copy is there: else no
    conditional request, as its answer would prove nothing). Faults of the server and missing answers are tried again
    after 2, 4, 8 seconds at most; between items of a task is a pause, so the number of partitions sets the rate. Task
    retries may ask again for what a lost executor had.
    """
    known = [c if c in items.columns else None for c in ("etag", "last_modified", "at_hand")]
    allowed = items.filter(T.url_error("url").isNull()).select("chave", "url", *[(F.col(c) if c else F.lit(None)).cast("boolean" if k == 2 else "string").alias(f"x{k}") for k, c in enumerate(known)])

    def run(batches):
        first = True
        for batch in batches:
            for key, url, etag, modified, there in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not first and pause:
                    wait(pause)
                first = False
                asked = {name: v for name, v in (("If-None-Match", etag), ("If-Modified-Since", modified)) if v and there}
                status, headers, body = None, {}, b""
                for k in range(1, attempts + 1):
                    status, headers, body = fetcher(url, asked)
                    if status in (200, 304) or (status is not None and 400 <= status < 500) or k == attempts:
                        break
                    wait(min(2**k, 8))
                row = (key, url, status, [*headers.items()], body, hashlib.sha256(body).hexdigest() if body else None)
                types = (pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], ["chave", "url", "status", "headers", "body", "sha256"])

    return allowed.mapInArrow(run, "chave string, url string, status int, headers map<string,string>, body binary, sha256 string")


def download(decisions: DataFrame, items: DataFrame, registry: DataFrame, fetched: DataFrame, folder: str) -> DataFrame:
    """chave, estado, erro, bytes, sha256, etag, last_modified, caminho of the items that decide marked `descarregar`.

    fetched: fetch's answers, written once before (so no address is asked twice). Stored documents go below the folder as
    year/number/file, which all executors see, by temporary name and rename; what is no PDF, or would replace another file
    that nobody recorded, is not stored.
    """
    rows = decisions.filter("estado = 'descarregar'").select("chave").join(items.select("chave", "ano", "num_bte", "ficheiro", "url"), "chave")
    rows = rows.join(registry.select("chave", F.col("sha256").alias("recorded"), F.col("local_sha256").alias("local")), "chave", "left").join(fetched.select("chave", "status", "headers", "body", F.col("sha256").alias("got")), "chave", "left")
    out = download_outcome(F.col("url"), F.col("status"), F.col("body"), F.col("recorded"), F.col("local"))
    low = F.map_from_entries(F.transform(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]), e["value"])))
    path = F.concat_ws("/", F.col("ano").cast("string"), F.col("num_bte").cast("string"), T.safe_name("ficheiro"))
    rows = rows.select("chave", out["estado"].alias("estado"), out["erro"].alias("erro"), F.octet_length("body").cast("long").alias("bytes"), F.col("got").alias("sha256"), low["etag"].alias("etag"), low["last-modified"].alias("last_modified"), path.alias("caminho"), "body")

    def store(batches):
        for batch in batches:
            for k, state in enumerate(batch.column(1).to_pylist()):
                if state == "descarregado":
                    place = os.path.join(folder, batch.column(7)[k].as_py())
                    os.makedirs(os.path.dirname(place), exist_ok=True)
                    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(place), suffix=".part")
                    with os.fdopen(handle, "wb") as f:
                        f.write(batch.column(8)[k].as_py())
                    os.replace(temporary, place)
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], batch.schema.names[:-1])

    return rows.mapInArrow(store, "chave string, estado string, erro string, bytes long, sha256 string, etag string, last_modified string, caminho string")


def merged_entries(entries: DataFrame, told: DataFrame) -> DataFrame:
    """chave, entry (JSON): what a run told of a document's download put over its entry; all that the run doesn't know stays.

    entries: chave, entry; told: chave and the fields of `descarga`, null where there is nothing to say. A document without
    an entry gets one.
    """
    fields = [c for c in told.columns if c != "chave"]
    rows = entries.select("chave", "entry").join(told.select("chave", F.to_json(F.struct(*fields)).alias("x_told")), "chave", "full")

    def run(batches):
        for batch in batches:
            out = []
            for key, entry, new in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if new is not None:
                    now = json.loads(entry) if entry else {"chave": key}
                    now["descarga"] = {**(now.get("descarga") or {}), **json.loads(new)}
                    entry = json.dumps(now, ensure_ascii=False)
                out.append(entry)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["chave", "entry"])

    return rows.mapInArrow(run, "chave string, entry string")


def collect_summary(decisions: DataFrame) -> DataFrame:
    """estado, tipo, n: totals by state, by unknown type, and of all, in one pass."""
    unknown = F.when(F.col("motivo").startswith("tipo desconhecido"), F.coalesce(F.nullif(F.col("tipo"), F.lit("")), F.lit("(sem tipo)")))
    return decisions.withColumn("unknown", unknown).groupingSets([[F.col("estado")], [F.col("unknown")], []], "estado", "unknown").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
