"""Where graphs come from: files of artifacts, archives, notes, help texts, stored graphs."""
