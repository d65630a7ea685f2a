"""Cases in HDF5 files as a Spark data source: ``spark.read.format("flow4d")``.

A file has ``img_complex`` (X, Y, Z, T, 4; channel 0 the reference) and ``segmask`` (X, Y, Z[, T]), and may have
``Resolution``, ``VENC``, ``RR``, ``SpatialOrder``, ``VENCOrder``.  Its name without suffix is the case.  Options:

* ``table``: ``raw_signal``, ``seg``, ``case_meta`` or ``status`` (see rheolake/schema.py and STATUS);
* ``slabs``: a case is read by that many tasks, each taking its share of the times;
* ``pad``: voxels around the mask's box that ``raw_signal`` keeps; negative: the whole volume;
* ``mode``: FAILFAST, or PERMISSIVE, where files that cannot be read give no rows and ``status`` says why;
* ``library``: the module that opens files, h5py unless told otherwise.

The driver lists files only; a task opens its file, reads the mask's box, and of the signal one time at a time within it.
Files must lie where executors can open them by path.  The mask is cut the same way by ``cases.oriented_case``.
"""

from __future__ import annotations

import json
import posixpath
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

from rheolake import schema
from rheolake.sources.cases import DEFAULTS, discover

STATUS = "case_id string, path string, status string, error string"
TABLES = {"raw_signal": schema.RAW_SIGNAL, "seg": schema.SEG, "case_meta": schema.CASE_META, "status": STATUS}


def local_path(uri: str) -> str:
    found = urlparse(uri)
    return unquote(found.path) if found.scheme == "file" else uri


def case_name(path: str) -> str:
    return posixpath.splitext(posixpath.basename(path))[0]


def case_files():
    """The data source's class.  It is made in here so that it travels to workers by value."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    tables, defaults, name_of = TABLES, DEFAULTS, case_name

    class Slab(InputPartition):
        def __init__(self, path: str, number: int):
            self.path, self.number = path, number

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.table = options.get("table", "raw_signal")
            self.paths = json.loads(options["files"])
            self.slabs = max(1, int(options.get("slabs", "1")))
            self.pad = int(options.get("pad", "2"))
            self.permissive = options.get("mode", "FAILFAST").upper() == "PERMISSIVE"
            self.library = options.get("library", "h5py")
            if self.table not in tables:
                raise ValueError(f"unknown table {self.table!r}")

        def partitions(self):
            parts = self.slabs if self.table in ("raw_signal", "seg") else 1
            return [Slab(p, n) for p in self.paths for n in range(parts)] or [Slab("", 0)]

        def read(self, slab):
            import importlib

            if not slab.path:
                return
            case, problem = name_of(slab.path), None
            try:
                with importlib.import_module(self.library).File(slab.path, "r") as file:
                    missing = [n for n in ("img_complex", "segmask") if n not in file]
                    if missing:
                        raise ValueError(f"{', '.join(missing)} missing")
                    check_shapes(file)
                    if self.table != "status":
                        yield from getattr(self, self.table)(file, case, slab.number)
            except Exception as error:
                if self.table != "status" and not self.permissive:
                    raise ValueError(f"{slab.path}: {error}") from error
                problem = f"{type(error).__name__}: {error}"
            if self.table == "status":
                yield (case, slab.path, "error" if problem else "ok", problem)

        def times(self, total: int, number: int) -> range:
            return range(total * number // self.slabs, total * (number + 1) // self.slabs)

        def case_meta(self, file, case, number):
            import numpy as np

            def value(name, default, kind):
                return np.atleast_1d(np.asarray(file[name][()])).astype(kind).tolist() if name in file else default

            yield (
                case, [int(n) for n in file["img_complex"].shape[:3]], value("Resolution", defaults["spacing"], float), [0.0, 0.0, 0.0],
                value("VENC", defaults["venc"], float), float(value("RR", [defaults["rr"]], float)[0]),
                value("SpatialOrder", defaults["spatial_order"], str), value("VENCOrder", defaults["venc_order"], str),
            )

        def seg(self, file, case, number):
            import numpy as np

            mask = file["segmask"]
            for t in self.times(mask.shape[3] if mask.ndim == 4 else 1, number):
                labels = np.asarray(mask[..., t] if mask.ndim == 4 else mask[...]).astype(np.int16)
                at = np.argwhere(labels)
                if len(at):
                    yield batch(case, at, t, {"label": labels[tuple(at.T)]})

        def raw_signal(self, file, case, number):
            import numpy as np

            image = file["img_complex"]
            low, high = self.box(file)
            cut = tuple(slice(a, b) for a, b in zip(low, high, strict=True))
            places = np.stack(np.meshgrid(*(np.arange(a, b) for a, b in zip(low, high, strict=True)), indexing="ij"), -1).reshape(-1, 3)
            for t in self.times(image.shape[3], number):
                values = np.asarray(image[(*cut, t)]).reshape(len(places), -1)
                for ch in range(values.shape[1]):
                    own = values[:, ch]
                    yield batch(case, places, t, {"ch": np.full(len(own), ch, np.int32), "re": own.real.astype(float), "im": own.imag.astype(float)})

        def box(self, file) -> tuple[list[int], list[int]]:
            """The padded box of the mask over all times; the whole volume where the mask is empty."""
            import numpy as np

            mask, size = file["segmask"], [int(n) for n in file["img_complex"].shape[:3]]
            low, high = list(size), [0, 0, 0]
            for t in range(mask.shape[3]) if mask.ndim == 4 else [None]:
                filled = np.asarray(mask[...] if t is None else mask[..., t]) != 0
                for axis in range(3):
                    hit = np.flatnonzero(filled.any(tuple(a for a in range(3) if a != axis)))
                    if len(hit):
                        low[axis], high[axis] = min(low[axis], int(hit[0])), max(high[axis], int(hit[-1]) + 1)
            if self.pad < 0 or not all(high):
                return [0, 0, 0], size
            return [max(0, a - self.pad) for a in low], [min(n, b + self.pad) for b, n in zip(high, size, strict=True)]

    def check_shapes(file) -> None:
        image, mask = file["img_complex"].shape, file["segmask"].shape
        if len(image) != 5 or image[4] < 4:
            raise ValueError(f"img_complex must be (X, Y, Z, T, 4), is {tuple(image)}")
        if len(mask) not in (3, 4) or tuple(mask[:3]) != tuple(image[:3]):
            raise ValueError(f"segmask must be {tuple(image[:3])} with or without times, is {tuple(mask)}")
        if len(mask) == 4 and mask[3] not in (1, image[3]):
            raise ValueError(f"segmask has {mask[3]} times, img_complex {image[3]}")

    def batch(case, places, t, columns):
        import numpy as np
        import pyarrow as pa

        found = {"case_id": pa.array([case] * len(places))} | {c: pa.array(places[:, n].astype(np.int32)) for n, c in enumerate("ijk")}
        found |= {"t": pa.array(np.full(len(places), t, np.int32))} | {n: pa.array(v) for n, v in columns.items()}
        return pa.RecordBatch.from_arrays(list(found.values()), list(found))

    class CaseFiles(DataSource):
        @classmethod
        def name(cls):
            return "flow4d"

        def schema(self):
            return tables[self.options.get("table", "raw_signal")]

        def reader(self, schema):
            return Reader(dict(self.options))

    return CaseFiles


def read_cases(spark: SparkSession, inputs: list[str], table: str, **options: object) -> DataFrame:
    """A table of all case files below the inputs.  Two files of one name would be one case, so that is an error."""
    paths = [local_path(r.path) for r in discover(spark, inputs).collect()]  # file names only
    names = [case_name(p) for p in paths]
    twice = sorted({n for n in names if names.count(n) > 1}) if len(set(names)) < len(names) else []
    if twice:
        raise ValueError(f"more than one file is named {', '.join(twice)}")
    spark.dataSource.register(case_files())
    return spark.read.format("flow4d").options(table=table, files=json.dumps(paths), **options).load()
