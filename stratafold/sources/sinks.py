"""Sinks: binary STL meshes, one file a mesh, and zipped XML models, written where the triangles are; zipped bundles; JSON lines."""

from __future__ import annotations

import os
import struct
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from xml.sax.saxutils import quoteattr

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FACET = np.dtype([("normal", "<f4", 3), ("corners", "<f4", (3, 3)), ("attribute", "<u2")])


def stl_bytes(corners: np.ndarray) -> bytes:
    """A binary STL of triangles (n, 3, 3): 80-byte header, count, facets with unit normals."""
    facets = np.zeros(len(corners), _FACET)
    normal = np.cross(corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0])
    length = np.linalg.norm(normal, axis=1, keepdims=True)
    facets["normal"] = np.divide(normal, length, out=np.zeros_like(normal), where=length > 0)
    facets["corners"] = corners
    return b"\0" * 80 + struct.pack("<I", len(facets)) + facets.tobytes()


def publish(path: str, data: bytes) -> bool:
    """Write a file once: whole or not at all, and an existing one stays. True if this call wrote it."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path))
    try:
        with os.fdopen(handle, "wb") as file:
            file.write(data)
            file.flush()
            os.fsync(file.fileno())
        os.link(temporary, path)
        return True
    except FileExistsError:
        return False
    finally:
        os.unlink(temporary)


def write_stl(triangles: DataFrame, vertices: DataFrame, mesh: str, folder: str) -> DataFrame:
    """One ``<mesh>.stl`` per value of the ``mesh`` column of both tables in a folder that all executors share; gives
    ``mesh, triangles, bytes``. A task holds one mesh, the unit of a file."""
    joined = triangles
    for k in ("a", "b", "d"):
        joined = joined.join(vertices.select(F.col(mesh), F.col("vid").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in "xyz")), [mesh, k])
    names = [f"{k}_{c}" for k in ("a", "b", "d") for c in "xyz"]

    def write(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("tid")
        corners = np.stack([table.column(n).to_numpy() for n in names], axis=1).reshape(-1, 3, 3).astype(np.float64)
        data = stl_bytes(corners)
        publish(os.path.join(folder, f"{key[0].as_py()}.stl"), data)
        return pa.table({"mesh": [str(key[0].as_py())], "triangles": pa.array([len(corners)], pa.int64()), "bytes": pa.array([len(data)], pa.int64())})

    return joined.select(mesh, "tid", *names).groupBy(mesh).applyInArrow(write, "mesh string, triangles long, bytes long")


_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="model" ContentType="application/vnd.ms-package.3dmanufacturing-3dmodel+xml"/></Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Target="/3D/3dmodel.model" Id="rel0" Type="http://schemas.microsoft.com/3dmanufacturing/2013/01/3dmodel"/></Relationships>'


class ModelWriter:
    """A zipped XML model that is written as it comes: meshes one after the other, of each the vertices and then the triangles.

    Held at once are a mesh's vertex ids and one batch of rows.
    """

    def __init__(self, path: str, colours: Sequence[str]) -> None:
        self.path = path
        os.makedirs(os.path.dirname(path), exist_ok=True)
        self.temporary = f"{path}.{uuid.uuid4().hex}"
        self.zip = zipfile.ZipFile(self.temporary, "w", zipfile.ZIP_DEFLATED)
        self.zip.writestr("[Content_Types].xml", _TYPES)
        self.zip.writestr("_rels/.rels", _RELS)
        self.entry = self.zip.open("3D/3dmodel.model", "w", force_zip64=True)
        bases = "".join(f'<base name="{i}" displaycolor={quoteattr(c)}/>' for i, c in enumerate(colours))
        self._put(f'<?xml version="1.0" encoding="UTF-8"?><model unit="millimeter" xmlns="http://schemas.microsoft.com/3dmanufacturing/core/2015/02"><resources><basematerials id="1">{bases}</basematerials>')
        self.meshes: list[str] = []
        self.ids = np.zeros(0, np.int64)
        self.state = ""
        self.triangles = 0

    def _put(self, text: str) -> None:
        self.entry.write(text.encode())

    def _close_mesh(self) -> None:
        if self.state == "vertices":
            self._put("</vertices><triangles>")
        if self.state:
            self._put("</triangles></mesh></object>")
        self.state = ""

    def vertices(self, mesh: str, ids: np.ndarray, points: np.ndarray) -> None:
        """More vertices of a mesh, in rising order of their ids."""
        if not self.meshes or self.meshes[-1] != mesh or self.state != "vertices":
            self._close_mesh()
            self.meshes.append(mesh)
            self.ids = np.zeros(0, np.int64)
            self._put(f'<object id="{len(self.meshes) + 1}" type="model" name={quoteattr(mesh)} pid="1" pindex="0"><mesh><vertices>')
            self.state = "vertices"
        self.ids = np.concatenate([self.ids, ids])
        self._put("".join(f'<vertex x="{x:g}" y="{y:g}" z="{z:g}"/>' for x, y, z in np.round(points, 5).tolist()))

    def faces(self, corners: np.ndarray, materials: np.ndarray) -> None:
        """More triangles of the mesh at hand, by vertex ids."""
        if self.state == "vertices":
            self._put("</vertices><triangles>")
            self.state = "triangles"
        at = np.searchsorted(self.ids, corners)
        if self.state != "triangles" or (at >= len(self.ids)).any() or (self.ids[np.minimum(at, len(self.ids) - 1)] != corners).any():
            raise ValueError("a triangle names a vertex that its mesh lacks")
        self._put("".join(f'<triangle v1="{a}" v2="{b}" v3="{c}" pid="1" p1="{m}"/>' for (a, b, c), m in zip(at.tolist(), materials.tolist())))
        self.triangles += len(corners)

    def finish(self) -> None:
        self._close_mesh()
        items = "".join(f'<item objectid="{i + 2}"/>' for i in range(len(self.meshes)))
        self._put(f"</resources><build>{items}</build></model>")
        self.entry.close()
        self.zip.close()
        os.replace(self.temporary, self.path)


def write_models(triangles: DataFrame, vertices: DataFrame, model: str, mesh: str, folder: str, colours: Sequence[str]) -> DataFrame:
    """One ``<model>.3mf`` per value of ``model`` in a folder that all executors share, its meshes in order; gives ``model, meshes,
    triangles``. ``triangles`` have ``tid, a, b, d, material``, ``vertices`` ``vid, x, y, z``, both the model and mesh columns.

    A model's rows are sorted and streamed through one task, the unit of a file, batch by batch: a bounded, ordered
    channel from the partitions to the writer.
    """
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    head = lambda part, at: [F.col(model).cast("string").alias("model"), F.col(mesh).cast("string").alias("mesh"), F.lit(part).alias("part"), F.col(at).cast("long").alias("at")]
    points = vertices.select(*head(0, "vid"), *(F.col(c).cast("double").alias(c) for c in "xyz"), *none("long", "a", "b", "d"), *none("int", "material"))
    faces = triangles.select(*head(1, "tid"), *none("double", *"xyz"), *(F.col(c).cast("long").alias(c) for c in ("a", "b", "d")), F.col("material").cast("int"))
    ordered = points.unionByName(faces).repartition("model").sortWithinPartitions("model", "mesh", "part", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, name = None, None

        def done() -> pa.RecordBatch:
            writer.finish()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(writer.meshes)], pa.int64()), pa.array([writer.triangles], pa.int64())], names=["model", "meshes", "triangles"])

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if keys[lo][0] != name:
                    if writer:
                        yield done()
                    name = keys[lo][0]
                    writer = ModelWriter(os.path.join(folder, f"{name}.3mf"), colours)
                columns = {f: part.column(f).to_numpy(zero_copy_only=False) for f in ("at", "x", "y", "z", "a", "b", "d", "material")}
                if keys[lo][2] == 0:
                    writer.vertices(keys[lo][1], columns["at"], np.stack([columns[c] for c in "xyz"], axis=1))
                else:
                    writer.faces(np.stack([columns[c] for c in ("a", "b", "d")], axis=1).astype(np.int64), columns["material"].astype(np.int64))
        if writer:
            yield done()

    return ordered.mapInArrow(run, "model string, meshes long, triangles long")


def read_stl(data: bytes) -> np.ndarray:
    return np.frombuffer(data, _FACET, offset=84)["corners"]


def bundle(rows: Iterator[tuple[str, bytes]], path: str) -> dict[str, int]:
    """A stored (uncompressed) zip of named contents, and how many entries each first folder has."""
    counts: dict[str, int] = {}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as out:
        for name, content in rows:
            out.writestr(name, content)
            head = name.split("/")[0]
            counts[head] = counts.get(head, 0) + 1
    return counts


def events_json(df: DataFrame) -> DataFrame:
    """Rows as JSON lines for a text sink."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
