"""Files that tasks write and read in the shared folder.

Tasks write under a name of their own attempt and report it in their output rows.  The table of these rows is
committed by Spark, or collected, so that files of failed or repeated attempts are simply not listed.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa


def open_folder(folder: str):
    """The file system of ``folder`` and the folder's path on it."""
    from pyarrow import fs

    folder = re.sub(r"^file:/+", "/", folder)
    if folder.startswith("/"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


def reachable(folder: str) -> bool:
    """Whether tasks can open files of the folder by themselves; what only Spark's readers know is not."""
    try:
        open_folder(folder)
    except (OSError, ValueError, NotImplementedError):  # pyarrow's own errors are kinds of these
        return False
    return True


def new_file(folder: str, suffix: str):
    """A new file's full name as reported, and a stream to write it."""
    system, path = open_folder(folder)
    system.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    return f"{folder.rstrip('/')}/{name}", system.open_output_stream(f"{path}/{name}", compression=None)


def open_file(name: str):
    system, path = open_folder(name)
    return system.open_input_file(path)


def delete_file(name: str) -> None:
    system, path = open_folder(name)
    system.delete_file(path)


def cell_writer(folder: str, others: int):
    """A function for ``mapInArrow`` that writes rows (block, other, whole numbers ...), sorted by block and other, as one file a block.

    A file holds cell after cell, each column of a cell by itself, and in the end where each of the ``others`` cells ends.  The rows returned
    are (block, name).
    """
    def write(batches):
        block, other, name, stream, ends, held = None, None, None, None, None, []

        def end_cell():
            if held:
                rows = np.concatenate(held)
                stream.write(np.ascontiguousarray(rows.T).tobytes())
                ends[other + 1 :] = ends[other] + len(rows)
                held.clear()

        def end_block():
            end_cell()
            stream.write(ends.tobytes())
            stream.close()
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([name])], names=["block", "name"])

        for b in batches:
            keys = np.column_stack([c.to_numpy().astype(np.int64) for c in b.columns])
            cuts = np.flatnonzero((keys[1:, :2] != keys[:-1, :2]).any(axis=1)) + 1
            for rows in np.split(keys, cuts) if len(keys) else []:
                if block is not None and (rows[0, 0], rows[0, 1]) != (block, other):
                    end_cell()
                if rows[0, 0] != block:
                    if block is not None:
                        yield end_block()
                    name, stream = new_file(folder, ".cells")
                    ends = np.zeros(others + 1, np.int64)
                block, other = int(rows[0, 0]), int(rows[0, 1])
                held.append(rows[:, 2:])
        if block is not None:
            yield end_block()

    return write


def read_cell(name: str, other: int, others: int, columns: int):
    """The columns of one cell of a :func:`cell_writer` file."""
    with open_file(name) as f:
        f.seek(f.size() - 8 * (others + 1))
        lo, hi = np.frombuffer(f.read(), np.int64)[other : other + 2].tolist()
        f.seek(8 * columns * lo)
        return np.frombuffer(f.read(8 * columns * (hi - lo)), np.int64).reshape(columns, -1)


def write_numbers(folder: str, suffix: str, *arrays) -> str:
    """Arrays of eight-byte numbers, one after the other, in a new file."""
    name, stream = new_file(folder, suffix)
    with stream:
        for a in arrays:
            stream.write(np.ascontiguousarray(a))
    return name


def read_numbers(name: str):
    """A file's doubles, in an array that can be changed."""
    with open_file(name) as f:
        data = np.empty(f.size() // 8)
        f.readinto(data)
    return data
