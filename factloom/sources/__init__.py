"""Where facts come from and go to: tables, files, federated services, mailboxes, generated schemas."""
