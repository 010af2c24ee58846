from pricelens import session


class Named:
    """Stands for a session that names (or lacks) a shared folder."""

    def __init__(self, folder, master):
        self.conf = self
        self.sparkContext = self
        self.folder, self.master, self.applicationId = folder, master, "app-1"

    def get(self, key, default=None):
        return self.folder or default


def test_work_dir_follows_the_session():
    assert session.work_dir(Named("/shared/x/", "spark://host")) == "/shared/x"
    local = session.work_dir(Named(None, "local[2]"))
    assert local == session.work_dir(Named(None, "local[2]"))
    try:
        session.work_dir(Named(None, "spark://host"))
    except ValueError:
        return
    raise AssertionError("a cluster without a shared folder was accepted")
