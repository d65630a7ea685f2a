"""What the HDF5 library offers to the reader, over .npz contents: no such library is installed here."""

import numpy as np


class File:
    def __init__(self, path, mode):
        self.path = path

    def __enter__(self):
        with open(self.path, "rb") as f:
            found = np.load(f, allow_pickle=False)
            return {n: found[n] for n in found.files}

    def __exit__(self, *_):
        return False
