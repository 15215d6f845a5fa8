"""An opener whose files fail now and then, named to the tar reader in tests."""

import io

from tessella.sources import stores

_seen: dict[tuple[str, int], int] = {}


class Flaky(io.FileIO):
    def read(self, n=-1):
        k = _seen.get(key := (str(self.name), self.tell()), 0)
        if k < 2:
            _seen[key] = k + 1
            raise ConnectionResetError("injected")
        return super().read(max(1, n // 2))


def flaky(path, offset):
    f = Flaky(stores.uri_parts(path)[2])
    f.seek(offset)
    return f
